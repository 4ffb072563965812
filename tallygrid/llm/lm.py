"""Language-model scores of whole documents with a gated recurrent network.

Tokens are lower-cased words and one end for each text. The symbols of the
network are the end, the most frequent words, and groups of all other words by
their last letters; their number grows with the root of the number of distinct
training words (``shape_for``). A word of a group has the group's probability
times its share of the group's training count, so every word has a probability,
unseen ones too.

``fit`` counts all training words (tasks count their own, a shuffle sums), then
trains on all training texts in ``ROUNDS`` parts. A part's texts are dealt by
their hash into groups that each hold enough for ``LEAST_UPDATES`` updates; the
number of groups follows from the number of tokens. Every group begins with the
common weights, learns from its texts by truncated backpropagation in the order
of their hashes, and the weights are averaged by the number of symbols behind
them. So weights and scores depend on the rows alone, not on how they are
partitioned. ``score`` carries the state through each whole text.

Counts of the most frequent words (at most ``KNOWN``) are broadcast; tokens of
rarer ones leave the task as rows and meet their counts in a join.

Cases: a null or empty text is its end alone. Nothing to learn from, or an empty
table, gives uniform symbols. Repeated rows and null ids keep their rows; copies
of a text go to groups by their ids. A text of any length is scored and learned
from as a whole, in windows; a task holds one such text, or some megabytes of
shorter ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package, written
from .gru import Network, Shape, Trainer, initial
from .text import id_and_text, slices, words_of

# the least shape
SHAPE = Shape()
ENDING = 3
# words whose counts every task may hold
KNOWN = 1 << 20
ROUNDS = 3
# a group with few texts repeats them until it made so many updates in a round
LEAST_UPDATES = 150
# tokens of a group in a round: full windows for the least updates
GROUP_TOKENS = LEAST_UPDATES * Trainer.LANES * Trainer.STEPS
# groups in a round at most; beyond it they grow instead
MOST_GROUPS = 4096
# weights that travel as one row
BLOCK = 4096
# words a task remembers before it begins anew
REMEMBERED = 250_000
# words held as objects at once
AT_ONCE = 100_000
# text that runs in lanes together
BATCH_BYTES = 16 << 20
END = b" "


def shape_for(distinct: int) -> Shape:
    """Shape for so many distinct training words; classes and their members grow alike.

    The least shape holds up to 65,536 words; 16 times as many words double its classes.
    """
    side = int(np.ceil(2 * max(distinct, 0) ** 0.25))
    return Shape(max(SHAPE.classes, side), max(SHAPE.members, side), SHAPE.state)


def named(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and 32-bit hash of its ending."""
    import xxhash

    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    ending = np.fromiter((xxhash.xxh32_intdigest(w[-ENDING:]) for w in words), np.int64, len(words))
    return h.view(np.int64), ending


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``ending`` (hashes) and ``n`` over all texts, the end included."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    held.update(words_of(text))
                held[END] += part.num_rows
                if len(held) > REMEMBERED:
                    yield packed(held)
                    held = Counter()
        yield packed(held)

    def packed(held: Counter) -> pa.RecordBatch:
        h, ending = named(list(held))
        n = np.fromiter(held.values(), np.int64, len(held))
        return pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(ending), pa.array(n)], ["word", "ending", "n"]
        )

    rows = docs.select("text").mapInArrow(count, "word long, ending long, n long")
    return rows.groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class WordModel:
    """What a task knows of words: symbols, counts, and how groups share their probability."""

    shape: Shape
    total: int  # N: training tokens
    distinct: int  # V: distinct ones
    head: dict[int, int]  # hash to symbol
    place: np.ndarray  # symbol to its place in the classes
    words: np.ndarray  # sorted hashes of the known words
    counts: np.ndarray
    group_total: np.ndarray  # log10 of what divides a count of the group
    frequency: np.ndarray  # training tokens by place
    least: int  # fewest occurrences of a known word

    @property
    def groups(self) -> int:
        """Symbols that are groups of words; the others are words or the end."""
        return self.shape.symbols - self.shape.symbols // 2

    @property
    def base_total(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))


def word_model(counts: DataFrame) -> WordModel:
    """Symbols and the broadcast part of the counts; ``counts`` is a written table."""
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    shape = shape_for(int(sums.v))
    most = shape.symbols // 2
    counts = counts.withColumn("grp", F.col("ending") % (shape.symbols - most))
    end = int(named([END])[0][0])
    top = counts.where(F.col("word") != end).orderBy(F.desc("n"), "word").limit(most - 1).collect()
    ends = counts.where(F.col("word") == end).collect()
    head = {end: 0} | {r.word: n + 1 for n, r in enumerate(top)}
    mass, types = (np.zeros(shape.symbols) for _ in range(2))
    for r in counts.groupBy("grp").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[most + r.grp], types[most + r.grp] = r.n, r.v
    for r in [*ends, *top]:
        mass[head[r.word]] = r.n
        mass[most + r.grp] -= r.n
        types[most + r.grp] -= 1
    order = np.argsort(-mass, kind="stable")
    place = np.empty(shape.symbols, np.int64)
    place[order] = np.arange(shape.symbols)
    # the smallest count from which on the words fit the broadcast
    bins = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().collect()
    held, least = 0, 1
    for n, words in sorted(((r.n, r["count"]) for r in bins), reverse=True):
        held += words
        if held > KNOWN:
            least = n + 1
            break
    known = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    # the head is always known
    words = np.r_[known.column("word").to_numpy(), np.array([r.word for r in [*ends, *top]], np.int64)]
    n = np.r_[known.column("n").to_numpy(), np.array([r.n for r in [*ends, *top]], np.int64)]
    words, by = np.unique(words, return_index=True)
    return WordModel(
        shape=shape,
        total=int(sums.n or 0),
        distinct=int(sums.v),
        head=head,
        place=place,
        words=words,
        counts=n[by],
        group_total=np.log10(mass[most:] + 0.5 * (types[most:] + 1)),
        frequency=mass[order],
        least=least,
    )


class Rows(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self.fresh.append(word)
        return row


class Reader:
    """Turns texts into symbols; remembers words between batches."""

    def __init__(self, model: WordModel):
        self.m = model
        self.heads = np.array(sorted(model.head), np.int64)
        self.head_symbol = np.array([model.head[w] for w in sorted(model.head)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.rows = Rows()
        self.hash, self.group, self.place, self.count = (np.empty(0, np.int64) for _ in range(4))
        self.in_head = np.empty(0, bool)

    def _learn(self, words: list[bytes]) -> None:
        m = self.m
        h, ending = named(words)
        group = ending % m.groups
        at = np.minimum(np.searchsorted(self.heads, h), len(self.heads) - 1)
        in_head = self.heads[at] == h
        symbol = np.where(in_head, self.head_symbol[at], m.shape.symbols - m.groups + group)
        count = np.full(len(h), -1)
        if len(m.words):
            at = np.minimum(np.searchsorted(m.words, h), len(m.words) - 1)
            count = np.where(m.words[at] == h, m.counts[at], -1)
        self.hash, self.group = np.r_[self.hash, h], np.r_[self.group, group]
        self.place, self.count = np.r_[self.place, m.place[symbol]], np.r_[self.count, count]
        self.in_head = np.r_[self.in_head, in_head]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the remembered words for all tokens, and the number of tokens by text."""
        if len(self.rows) > REMEMBERED:
            self._forget()
        found, words = [], []
        lengths = np.empty(len(texts), np.int64)
        for n, text in enumerate(texts):
            own = words_of(text)
            own.append(END)
            words += own
            lengths[n] = len(own)
            if len(words) > AT_ONCE:
                found.append(self._rows_of(words))
                words = []
        found.append(self._rows_of(words))
        return np.concatenate(found), lengths

    def _rows_of(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))
        if self.rows.fresh:
            self._learn(self.rows.fresh)
            self.rows.fresh = []
        return found


def begins_of(lengths: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.empty(0, np.int64)


def group_count(tokens: int, rounds: int) -> int:
    """Groups that learn side by side in a round."""
    return min(max(tokens // (rounds * GROUP_TOKENS), 1), MOST_GROUPS)


class Learner:
    """One group's network: learns from texts as they come, in batches of fixed size."""

    def __init__(self, words: WordModel, reader: Reader, flat: np.ndarray):
        self.trainer, self.reader = Trainer(Network(words.shape, flat)), reader
        self.texts: list[str] = []
        self.size = 0
        self.first = None

    def add(self, text: str) -> None:
        self.texts.append(text)
        self.size += len(text)
        if self.size >= BATCH_BYTES:
            self.learn()

    def learn(self) -> None:
        if not self.texts:
            return
        rows, lengths = self.reader.read(self.texts)
        held = (self.reader.place[rows].astype(np.int32), begins_of(lengths), lengths)
        self.trainer.learn(*held)
        self.first = self.first or held
        self.texts, self.size = [], 0

    def blocks(self, group: int) -> pa.RecordBatch:
        """The group's weights and the symbols behind them."""
        self.learn()
        symbols = self.trainer.symbols
        while self.trainer.updates < LEAST_UPDATES:
            self.trainer.learn(*self.first)
        flat = self.trainer.network.flat
        parts = [flat[at : at + BLOCK] for at in range(0, len(flat), BLOCK)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(parts), dtype=np.int32)),
                pa.array(np.full(len(parts), group, np.int32)),
                pa.array(np.full(len(parts), float(symbols))),
                pa.array(parts, pa.list_(pa.float32())),
            ],
            ["block", "grp", "n", "v"],
        )


def mean_block(rows: pa.Table) -> pa.Table:
    """Mean of one block over all groups, weighted by their symbols; at most ``MOST_GROUPS`` rows."""
    rows = rows.sort_by("grp")
    n = rows.column("n").to_numpy()
    values = np.stack(rows.column("v").to_numpy()).astype(np.float64)
    mean = (n @ values / n.sum()).astype(np.float32)
    return pa.table(
        {"block": rows.column("block").slice(0, 1), "v": pa.array([mean], pa.list_(pa.float32()))}
    )


def train(docs: DataFrame, words: WordModel, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the network after one pass over all texts (``id, text``), in ``rounds`` parts."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(words)
    flat = initial(words.shape, words.frequency)
    groups = group_count(words.total, rounds)
    part = F.pmod(F.xxhash64("text", "id", F.lit(11)), F.lit(rounds))
    dealt = docs.select("text", part.alias("part"), F.xxhash64("text", "id", F.lit(12)).alias("place"))
    dealt = dealt.withColumn("grp", F.pmod("place", F.lit(groups)).cast("int"))
    for n in range(rounds):
        begun = context.broadcast(flat)

        def learn(batches: Iterator[pa.RecordBatch], begun=begun) -> Iterator[pa.RecordBatch]:
            reader, group, learner = Reader(shared.value), None, None
            for batch in batches:
                for piece in slices(batch, BATCH_BYTES):
                    own = zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)
                    for of, text in own:
                        if of != group:
                            if learner:
                                yield learner.blocks(group)
                            group, learner = of, Learner(shared.value, reader, begun.value)
                        learner.add(text)
            if learner:
                yield learner.blocks(group)

        rows = dealt.where(F.col("part") == n).repartitionById(groups, "grp")
        rows = rows.sortWithinPartitions("grp", "place", "text").select("grp", "text")
        found = rows.mapInArrow(learn, "block int, grp int, n double, v array<float>")
        # one row for each block of the network
        mean = found.groupBy("block").applyInArrow(mean_block, "block int, v array<float>").toArrow()
        if mean.num_rows:
            mean = mean.sort_by("block")
            flat = np.concatenate(mean.column("v").to_numpy())
    return flat


@dataclass
class LanguageModel:
    words: WordModel
    weights: np.ndarray
    counts: DataFrame  # written table of all training words


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """Word counts and network from all rows of ``docs``."""
    texts = id_and_text(docs, id_col, text_col)
    counts = written(word_counts(texts), "word-counts")
    words = word_model(counts)
    return LanguageModel(words, train(texts, words), counts)


def score(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_tokens, n_known, base_score, score`` for every row; logarithms to base ten.

    ``base_score`` is that of the words' smoothed frequencies alone.
    """
    context = docs.sparkSession.sparkContext
    shared, weights = context.broadcast(model.words), context.broadcast(model.weights)
    ship_package(docs.sparkSession)
    rare = "array<struct<word:bigint,total:double,times:int>>"
    rare_type = pa.list_(
        pa.struct([("word", pa.int64()), ("total", pa.float64()), ("times", pa.int32())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        network, reader = Network(words.shape, weights.value), Reader(words)
        for batch in batches:
            for piece in slices(batch, BATCH_BYTES):
                rows, lengths = reader.read(piece.column(1).to_pylist())
                begins = begins_of(lengths)
                places = reader.place[rows].astype(np.int32)
                logs = network.score(places, begins, lengths) / np.log(10)
                count = reader.count[rows]
                # the end is no rare word: it is known or was never seen
                known = (count >= 0) | reader.in_head[rows]
                own = np.log10(np.maximum(count, 0) + 0.5)
                base = np.where(known, own - words.base_total, 0.0)
                grouped = own - words.group_total[reader.group[rows]]
                inside = np.where(known & ~reader.in_head[rows], grouped, 0.0)
                left = np.flatnonzero(~known)
                text = np.repeat(np.arange(len(lengths)), lengths)
                pairs, times = np.unique(
                    text[left] * len(reader.hash) + rows[left].astype(np.int64),
                    return_counts=True,
                )
                row, of = pairs % len(reader.hash), pairs // len(reader.hash)
                offsets = np.searchsorted(of, np.arange(len(lengths) + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays(
                    [
                        pa.array(reader.hash[row]),
                        pa.array(words.group_total[reader.group[row]]),
                        pa.array(times.astype(np.int32)),
                    ],
                    ["word", "total", "times"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(lengths),
                        pa.array(np.add.reduceat((known & (count > 0)).astype(np.int64), begins)),
                        pa.array(np.add.reduceat(base, begins)),
                        pa.array(logs + np.add.reduceat(inside, begins)),
                        pa.ListArray.from_arrays(pa.array(offsets), items).cast(rare_type),
                    ],
                    ["id", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    schema = f"id long, n_tokens long, n_known long, base_score double, score double, rare {rare}"
    parts = id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "scores")
    words = model.words
    few = model.counts.where(F.col("n") < words.least).select("word", "n")
    met = parts.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(few, "word", "left")
    own = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    added = met.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (own - words.base_total)).alias("more_base"),
        F.sum(F.col("times") * (own - F.col("total"))).alias("more_score"),
    )
    none = F.lit(0)
    return parts.join(added, "row", "left").select(
        "id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", none)).alias("n_known"),
        (F.col("base_score") + F.coalesce("more_base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", none)).alias("score"),
    )
