"""Shards by jump consistent hashing, and gapless places inside them, in DataFrame functions alone.

A key is hashed to 64 bits (the first half of the MD5 of its text). A linear
congruential generator seeded with it makes the key jump forward through shard
numbers; the last number below the count of shards is its shard. There is no
table of the ring, and nothing is looked up: key and count decide. The jumps do
not depend on the count, so one more shard receives the keys whose next jump
lands exactly on it, and no other key moves.

Numbers inside a shard (``slot``) follow (id, checksum, size). All rows are
sorted by ranges of (shard, id, checksum, size), which divide a shard, or one
id, over as many tasks as its rows need; a range adds the rows of its shard in
earlier ranges to its own running count. Texts are read once and never travel.

Cases: a null text has no bytes (size 1, checksum 0). Null ids are one key and
stand last in their shard. Rows with a repeated id share its shard and have
slots of their own; rows equal in id, checksum and size travel as one row with
its number and are told apart at the end. A text of any length is one row. An
empty table gives no rows. Only id and text are read, so other columns may have
any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

# fixed value: multiplier of the generator, as published with the method
MULTIPLIER = 2862933555777941757
LOW = (1 << 32) - 1

# jumps taken for every key; a key needs about ln(shards) of them
ROUNDS = 64
# equal rows that one row stands for while rows are sorted
TOGETHER = 1024

# stands for a null among the parts of a key
NO_VALUE = "\x00"


def key_halves(*keys: str) -> tuple[Column, Column]:
    """The upper and lower 32 bits of a key's hash."""
    parts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(NO_VALUE)) for k in keys]
    digest = F.md5(F.concat_ws("\x1f", *parts))
    return tuple(
        F.conv(F.substring(digest, begin, 8), 16, 10).cast("long") for begin in (1, 9)
    )


def advanced(state: Column) -> tuple[Column, Column]:
    """The generator's next value, ``key * MULTIPLIER + 1`` modulo 2**64, by halves.

    Products are split so that none exceeds 63 bits.
    """
    upper, lower = MULTIPLIER >> 32, MULTIPLIER & LOW
    first, second = F.lit(lower & 0xFFFF), F.lit(lower >> 16)
    hi, lo = state["hi"], state["lo"]

    def middle(x: Column) -> Column:
        return F.shiftleft((x * second).bitwiseAND(F.lit(0xFFFF)), 16)

    low = lo * first + middle(lo) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(lo * second, 16)
    high = hi * first + middle(hi) + lo * F.lit(upper) + carry
    return high.bitwiseAND(F.lit(LOW)), low.bitwiseAND(F.lit(LOW))


def _jumped(shards: int):
    def jump(state: Column, _: Column) -> Column:
        hi, lo = advanced(state)
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), state["next"].alias("at"))
        # 31 upper bits of the value choose how far the key jumps
        share = F.lit(float(1 << 31)) / (F.shiftright(moved["hi"], 1) + 1).cast("double")
        beyond = F.floor((moved["at"] + 1).cast("double") * share)
        done = state["next"] >= F.lit(shards)
        return F.when(done, state).otherwise(
            F.struct(moved["hi"].alias("hi"), moved["lo"].alias("lo"), moved["at"].alias("at"), beyond.alias("next"))
        )

    return jump


def jumps(shards: int, *keys: str) -> Column:
    """``at``, the shard of a key, and ``next``, its first jump at or beyond ``shards``.

    A key takes at most one jump for each shard and nearly always few; those
    that need more than ``ROUNDS`` go on one by one.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    hi, lo = key_halves(*keys)
    start = F.struct(
        hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next")
    )

    def steps(begin: int, end: int) -> Column:
        return F.sequence(F.lit(begin), F.lit(end))

    end = F.aggregate(steps(1, min(shards, ROUNDS)), start, _jumped(shards))
    if shards > ROUNDS:
        end = F.aggregate(F.array(end), start, lambda _, s: F.when(s["next"] >= shards, s).otherwise(
            F.aggregate(steps(ROUNDS + 1, shards), s, _jumped(shards))))
    return end


def with_shard(docs: DataFrame, shards: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` with the ``shard`` of every row and its ``grown_shard`` with one shard more.

    Columns of these names that ``docs`` already has are replaced.
    """
    kept = docs.drop("shard", "grown_shard")
    # an array of one, so that the jumps are made once for both columns
    found = kept.withColumn("__jumps", F.explode(F.array(jumps(shards, *keys))))
    at, beyond = F.col("__jumps.at"), F.col("__jumps.next")
    return found.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        at.cast("int").alias("shard"),
        F.when(beyond == shards, F.lit(shards)).otherwise(at).cast("int").alias("grown_shard"),
    )


def moving(docs: DataFrame, before: int, after: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows of ``docs`` that change their shard, with the old one and the new ``shard``."""
    old = with_shard(docs, before, keys).drop("grown_shard").withColumnRenamed("shard", "old_shard")
    both = with_shard(old, after, keys).drop("grown_shard")
    return both.where(F.col("shard") != F.col("old_shard"))


def write_shards(docs: DataFrame, path: str, shards: int, keys: tuple[str, ...] = ("doc_id",)) -> None:
    """Whole rows in one folder for each shard; every task writes its part of every shard."""
    with_shard(docs, shards, keys).drop("grown_shard").write.partitionBy("shard").parquet(path)


def slots(rows: DataFrame) -> DataFrame:
    """``rows`` (shard, grown_shard, id, size, crc) with ``slot``, from 0 in each shard without gaps."""
    columns = ["shard", "grown_shard", "id", "crc", "size"]
    same = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    packs = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / TOGETHER)))
    split = same.select("*", packs.alias("pack")).withColumn(
        "n", F.least(F.lit(TOGETHER), F.col("n") - F.col("pack") * TOGETHER)
    )
    order = [F.asc("shard"), F.asc_nulls_last("id"), F.asc("crc"), F.asc("size"), F.asc("pack")]
    ranged = split.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = written(
        ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")),
        "shard-ranges",
    )

    def before(name: str, window) -> Column:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(name).over(earlier), F.lit(0))

    # a row for each range and shard
    runs = stored.groupBy("part", "shard").agg(F.sum("n").alias("run"))
    offsets = runs.select(
        "part", "shard", before("run", Window.partitionBy("shard").orderBy("part")).alias("offset")
    )
    inside = before("n", Window.partitionBy("part", "shard").orderBy("place"))
    placed = stored.withColumn("inside", inside).join(offsets, ["part", "shard"])
    placed = placed.withColumn("first", F.col("offset") + F.col("inside"))
    once = placed.where("n = 1").withColumn("slot", F.col("first"))
    # what stands for many rows is dealt out again before it becomes them
    more = placed.where("n > 1").repartition("id", "crc", "size", "pack")
    more = more.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return once.unionByName(more).select(*columns, "slot")


def place(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, crc, shard, grown_shard, slot`` of every row of ``docs``.

    ``size`` is the text's bytes plus one, ``crc`` its CRC-32; the id is the key.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
    )
    return slots(with_shard(rows, shards, ("id",)))
