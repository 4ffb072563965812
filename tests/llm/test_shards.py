import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import sharding
from tallygrid.llm.queries import QUERIES
from tallygrid.llm.sharding import MULTIPLIER


def hashed(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:16], 16)


def jumped(key, shards):
    """The published loop, in unbounded integers."""
    at, beyond = -1, 0
    while beyond < shards:
        at = beyond
        key = (key * MULTIPLIER + 1) % 2**64
        beyond = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


def as_key(id_):
    return sharding.NO_VALUE if id_ is None else str(id_)


def slots_by_shard(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    return by


def check(docs, shards=16):
    given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = sharding.place(docs, shards).collect()
    sized = Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jumped(hashed(as_key(i)), shards),
         jumped(hashed(as_key(i)), shards + 1))
        for i, t in given
    )
    assert Counter((r.id, r.size, r.crc, r.shard, r.grown_shard) for r in rows) == sized
    for slots in slots_by_shard(rows).values():
        assert sorted(slots) == list(range(len(slots)))
    # slots follow the ids
    by_slot = sorted(rows, key=lambda r: (r.shard, r.slot))
    order = [(r.shard, r.id is None, r.id or 0, r.crc, r.size) for r in by_slot]
    assert order == sorted(order)
    return rows


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 100, 1000])
def test_shards_are_those_of_the_loop(spark, shards):
    rng = random.Random(shards)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(500)] + [0, -1, None]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for r in sharding.with_shard(docs, shards).collect():
        key = hashed(as_key(r.doc_id))
        assert (r.shard, r.grown_shard) == (jumped(key, shards), jumped(key, shards + 1))


def test_keys_that_need_more_rounds_go_on(spark, monkeypatch):
    docs = spark.range(300).withColumnRenamed("id", "doc_id")
    whole = sharding.with_shard(docs, 40).collect()
    monkeypatch.setattr(sharding, "ROUNDS", 2)
    assert sharding.with_shard(docs, 40).collect() == whole


def test_a_new_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    moved = sharding.moving(docs, 16, 17).collect()
    assert {r.shard for r in moved} == {16}
    # its fair share is one in 17
    assert abs(len(moved) / 20_000 - 1 / 17) < 0.01
    grown = sharding.with_shard(docs, 16).where("grown_shard <> shard")
    assert {r.doc_id for r in grown.collect()} == {r.doc_id for r in moved}


def test_shards_are_even(spark):
    counts = sharding.with_shard(spark.range(32_000).withColumnRenamed("id", "doc_id"), 16).groupBy("shard").count()
    assert all(abs(r["count"] - 2000) < 200 for r in counts.collect())


def test_odd_rows(docs_of):
    long = "x" * 200_000
    check(docs_of(["a", None, "", "é☃😀", long, "same", "same", "b"], [4, 3, None, 7, 1, 9, 9, None]))


def test_an_empty_table_has_no_rows(docs_of):
    assert sharding.place(docs_of([]), 16).collect() == []


def test_one_id_and_one_row_with_a_third_of_all_rows(spark, docs_of, monkeypatch):
    """Equal rows travel as few; texts under one id are divided by their checksum."""
    monkeypatch.setattr(sharding, "TOGETHER", 7)
    rng = random.Random(5)
    texts = ["copy"] * 1500 + [f"t{rng.random()}" for _ in range(3000)]
    check(docs_of(texts, [11] * 1500 + [12] * 1500 + list(range(1500))))


def test_columns_named_like_the_result_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, shard string, slot string")
    rows = sharding.with_shard(docs, 4).orderBy("doc_id").collect()
    assert [(r.slot, r.shard) for r in rows] == [("x", jumped(hashed("1"), 4)), ("y", jumped(hashed("2"), 4))]


def test_files_of_shards_hold_whole_rows(spark, docs_of, tmp_path):
    docs = docs_of([f"t{n}" for n in range(200)])
    sharding.write_shards(docs, f"{tmp_path}/out", 8)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.select(*docs.columns).collect()) == sorted(docs.collect())
    assert all(r.shard == jumped(hashed(str(r.doc_id)), 8) for r in back.collect())


def test_several_columns_make_a_key(spark):
    docs = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None)], "x string, y string")
    keys = ["a\x1fb", "ab\x1f", "ab\x1f\x00"]
    rows = sharding.with_shard(docs, 1000, ("x", "y")).collect()
    assert [r.shard for r in rows] == [jumped(hashed(k), 1000) for k in keys]


def test_no_python_in_the_plan(spark, tables):
    df = QUERIES["op11_sharding"](spark, tables)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
    assert df.count() == spark.read.parquet(f"{tables}/documents.parquet").count()
    law = df.select("law", (F.col("grown_shard") != F.col("shard")).alias("moves")).distinct().collect()
    assert {r.law for r in law} == {"key"} and len(law) == 2
