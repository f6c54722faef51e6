"""Scoring by partial matching: a trie of byte contexts with escapes and symbol exclusion.

Training counts which symbol follows each context of ORDER bytes; shorter contexts are sums of these, so the counts
are all levels of the trie. A symbol seen after the longest context has its share of n + d there (n occurrences, d
distinct symbols); else the escape share d / (n + d) goes to the next shorter context, whose probabilities are
freed from those of the symbols just excluded. After the empty context all symbols are equally likely.

Nothing is cut off: the trie is a table that grows with the corpus and is built by joins. Scoring sends it to the
workers in shards of bounded size, one after the other. A shard holds the contexts that end with certain three
bytes, with all shorter ones, so it knows all about a symbol after such a context, and a document's code length is
the sum of what the shards add.

Beside it stands the count of words (base score): words with at least FREQUENT of all tokens, of which there
are at most 1 / FREQUENT, go to the workers as a dictionary; the others are joined.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, give_back, map_batches, remove, staged, strings

#: Bytes of context, and of those that decide on the shard.
ORDER, CELL = 5, 3
#: Symbols: the bytes, of which END is in no UTF-8 text; it ends a text and stands before it.
SYMBOLS, END = 256, 0xFF
#: Entries of a shard, on average.
SHARD = 1 << 21
#: Share of all tokens from which on a word is kept by every worker.
FREQUENT = 1e-6
#: Longer words are known by their digest.
KEY_BYTES = 32
#: Words, and counted contexts with a symbol, that a worker gathers before it passes them on.
GATHER, GRAMS = 400_000, 4_000_000
#: Bytes counted, and scored, at once.
BLOCK, SCORED = 2 << 20, 1 << 18


def key_of(word: bytes) -> bytes:
    return word if len(word) <= KEY_BYTES else b"\0" + hashlib.sha256(word).digest()


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def gather(docs: DataFrame, text: str) -> DataFrame:
    """key, n: words of the texts. Added up within a task first."""

    def run(batches):
        give_back(__name__)
        words: Counter = Counter()

        def out():
            items = list(words.items())
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in items], pa.binary()), pa.array([n for _, n in items], pa.int64())], ["key", "n"])

        for batch in batches:
            for t in strings(batch, text):
                words.update(map(key_of, lowered(t).split()))
                if len(words) > GATHER:
                    yield out()
        if words:
            yield out()

    return docs.select(text).mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


PAD = bytes([END]) * 7
BITS = 8


def low(order: int) -> int:
    """The bits of the last `order` bytes."""
    return (1 << BITS * order) - 1


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' grams (a context's bytes and then the symbol, as one number), ends included, and where each text starts."""
    whole = b"".join([PAD + t + PAD[:1] for t in texts])
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    windows = np.ndarray((len(whole) - 7,), ">u8", whole, 0, (1,))  # the eight bytes from each place on
    places = np.arange(sizes.sum()) + np.repeat(7 * np.arange(len(texts)), sizes)
    return windows[places].astype(np.int64) & low(ORDER + 1), starts


def added(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's counts."""
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def follow(docs: DataFrame, text: str) -> DataFrame:
    """gram, n: how often a symbol follows a context of ORDER bytes."""

    def run(batches):
        give_back(__name__)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[bytes] = []
        size = 0

        def count():
            found.append(added(sequences(waiting)[0]))
            waiting.clear()

        def merged():
            return added(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))

        def out(keys, n):
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)].astype(np.int64))], ["gram", "n"])

        for batch in batches:
            for t in strings(batch, text):
                waiting.append(lowered(t))
                size += len(waiting[-1])
                if size > BLOCK:
                    count()
                    size = 0
                    if sum(len(k) for k, _ in found) > GRAMS:
                        found[:] = [merged()]
                        if len(found[0][0]) > GRAMS // 2:
                            yield from out(*found.pop())
        if waiting:
            count()
        if found:
            yield from out(*merged())

    return docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def cell_of(key, context):
    """The cell of a context, spread; the same for columns and arrays."""
    return ((context & low(CELL)) * 2654435769 >> 8) if key is None else F.shiftright(context.bitwiseAND(low(CELL)) * F.lit(2654435769), 8)


class Hash:
    """From whole numbers (not negative) to numbers, for arrays of keys at once; open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys there are, and their values (of others anything)."""
        slot = self.slot(keys)
        there = self.keys[slot]
        hit = there == keys
        going = np.flatnonzero(~hit & (there >= 0))
        while len(going):
            slot[going] = (slot[going] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[going]]
            hit[going] = there == keys[going]
            going = going[(there != keys[going]) & (there >= 0)]
        return hit, self.values[slot]


#: Levels are told apart by bits above a gram's: its own number for grams, and LEVELS more for contexts.
LEVEL, LEVELS = BITS * (ORDER + 1), 8


def trie(grams: DataFrame, folders: list[str]) -> DataFrame:
    """key, value, cell of all levels of the trie: log10 of a symbol's share at its context, and of the factor that
    the escape from a context gives to the next shorter one's probabilities. cell is null up to CELL - 1 bytes of context."""
    levels = [grams]
    for order in range(ORDER - 1, -1, -1):
        own = levels[0].groupBy(F.col("gram").bitwiseAND(low(order + 1)).alias("gram")).agg(F.sum("n").alias("n"))
        levels.insert(0, staged(own, folders, "grams"))
    entries, shorter = [], None
    context = Window.partitionBy("context")
    for order, own in enumerate(levels):
        own = own.withColumn("context", F.shiftright("gram", BITS))
        if shorter is None:
            own = own.withColumn("below", F.lit(1.0 / SYMBOLS))
        else:
            own = own.withColumn("shorter", F.col("gram").bitwiseAND(low(order))).join(shorter, "shorter")
        own = own.select(
            "gram", "context", "n", F.sum("n").over(context).alias("whole"), F.count("*").over(context).alias("kinds"),
            F.sum("below").over(context).alias("below"), (F.min("gram").over(context) == F.col("gram")).alias("first"),
        )
        escapes = F.when(F.col("kinds") < SYMBOLS, F.col("kinds")).otherwise(0)
        share = F.col("n") / (F.col("whole") + escapes)
        factor = F.when(escapes > 0, F.log10(escapes / (F.col("whole") + escapes)) - F.log10(F.greatest(1 - F.col("below"), F.lit(1e-15)))).otherwise(0.0)
        own = staged(own.select("gram", "context", share.alias("share"), F.when(F.col("first"), factor).alias("factor")), folders, "level")
        shorter = own.select(F.col("gram").alias("shorter"), F.col("share").alias("below"))
        cell = cell_of("key", F.col("context")) if order >= CELL else F.lit(None).cast("long")
        entries.append(own.select(F.col("gram").bitwiseOR(order << LEVEL).alias("key"), F.log10("share").cast("float").alias("value"), cell.alias("cell")))
        ends = own.filter("factor is not null")
        entries.append(ends.select(F.col("context").bitwiseOR((LEVELS + order) << LEVEL).alias("key"), F.col("factor").cast("float").alias("value"), cell.alias("cell")))
    out = entries[0]
    for more in entries[1:]:
        out = out.unionByName(more)
    return out


class Shard:
    """A part of the trie that knows all about certain contexts."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, number: int, shards: int):
        self.table, self.number, self.shards = Hash(keys, values), number, shards

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of symbols after their contexts."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            own = grams[left] & low(order + 1)
            hit, value = self.table.get(own | order << LEVEL)
            out[left[hit]] += value[hit]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return out
            hit, value = self.table.get(own >> BITS | (LEVELS + order) << LEVEL)
            out[left] += np.where(hit, value, 0)
        out[left] -= np.log10(SYMBOLS)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """What this shard's contexts add to log10 of each text's probability, its end included. texts: lower-cased."""
        grams, starts = sequences(texts)
        out = np.zeros(len(grams))
        if self.shards == 1:
            out = self.logs(grams)
        else:
            own = np.flatnonzero(cell_of(None, grams >> BITS) % self.shards == self.number)
            out[own] = self.logs(grams[own])
        return np.add.reduceat(out, starts)


def code_lengths(rows: DataFrame, grams: DataFrame, folders: list[str]) -> DataFrame:
    """row, score: log10 of each text's probability. rows: row, text."""
    spark = rows.sparkSession
    entries = trie(grams, folders)
    shards = max(1, -(-entries.filter("cell is not null").count() // SHARD))
    table = entries.withColumn("shard", F.coalesce(F.pmod("cell", F.lit(shards)), F.lit(-1)).cast("int")).drop("cell")
    folders.append(f"{folders[0]}-trie")
    table.write.partitionBy("shard").parquet(folders[-1])
    table = spark.read.schema(table.schema).parquet(folders[-1])
    folders.append(f"{folders[0]}-parts")
    for number in range(shards):
        own = table.filter(F.col("shard").isin(-1, number)).select("key", "value").toArrow()
        shared = spark.sparkContext.broadcast(Shard(own["key"].to_numpy(), own["value"].to_numpy(), number, shards))
        del own

        def make(shared=shared):
            shard = shared.value

            def function(batch):
                out: list[float] = []
                waiting: list[bytes] = []
                size = 0
                for t in strings(batch, "text"):
                    waiting.append(lowered(t))
                    size += len(waiting[-1])
                    if size > SCORED:
                        out += shard.scores(waiting).tolist()
                        waiting, size = [], 0
                if waiting:
                    out += shard.scores(waiting).tolist()
                return [out]

            return function

        map_batches(rows, [("score", T.DoubleType())], make, ["row"]).write.mode("append").parquet(folders[-1])
        shared.destroy()
    return spark.read.parquet(folders[-1]).groupBy("row").agg(F.sum("score").alias("score"))


def score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: the id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose held_out is not true. Letters A-Z are lower-cased. Tokens are the words between
    ASCII white space and one end; base_score adds log10((c + 1) / (N + V + 1)) of each, score is log10 of
    the probability of the bytes and the end under the trie. Null and empty texts consist of the end alone.
    With nothing to learn from, N = V = 0 and all symbols are equally likely. Repeated rows count and are
    scored as often as they occur; other columns are not read.

    What the driver collects and broadcasts is bounded: 1 / FREQUENT words of at most 33 bytes, and one shard at a
    time, of about SHARD entries beside those of contexts under CELL bytes (at most SYMBOLS ** CELL, in texts of a few
    languages some ten thousand). The rows are staged once and gone through once for each shard.
    """
    spark, folders = docs.sparkSession, []
    bound_batches(spark)
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")
    )
    rows = staged(rows, folders, "rows")
    train = rows.filter("not held_out")
    words = staged(gather(train, "text"), folders, "words")
    ends = train.count()
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    frequent = {bytes(k): c for k, c in words.filter(F.col("n") >= n * FREQUENT).collect()}
    whole = float(np.log10(n + v + 1))
    shared = spark.sparkContext.broadcast({k: float(np.log10(c + 1)) for k, c in frequent.items()})

    def make():
        get = shared.value.get
        end = float(np.log10(ends + 1))

        def function(batch):
            out: list[list] = [[], [], [], [], []]
            for t in strings(batch, "text"):
                tokens = lowered(t).split()
                found = list(map(get, tokens))
                missing: Counter = Counter()
                if None in found:
                    for i, x in enumerate(found):
                        if x is None:
                            key = key_of(tokens[i])
                            if (x := get(key)) is None:
                                missing[key] += 1
                                x = 0.0
                            found[i] = x
                out[0].append(len(tokens) + 1)
                out[1].append(len(tokens) + (ends > 0) - missing.total())
                out[2].append(sum(found) + end - (len(tokens) + 1) * whole)
                out[3].append(list(missing))
                out[4].append(list(missing.values()))
            return out

        return function

    fields = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("missing", T.ArrayType(T.BinaryType())), ("times", T.ArrayType(T.LongType()))]
    counted = staged(map_batches(rows, fields, make, ["id", "held_out", "row"]), folders, "counted")
    rare = words.filter(F.col("n") < n * FREQUENT)
    more = (
        counted.select("row", F.explode(F.arrays_zip("missing", "times")).alias("x"))
        .select("row", F.col("x.missing").alias("key"), F.col("x.times").alias("times"))
        .join(rare, "key")
        .groupBy("row")
        .agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    )
    grams = staged(follow(train, "text"), folders, "grams")
    scored = code_lengths(rows.select("row", "text"), grams, folders)
    out = staged(
        counted.drop("missing", "times").join(scored, "row").join(more, "row", "left").select(
            F.col("id").alias(id_column),
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
            "score",
        ),
        [],
        "scores",
    )
    for folder in folders:
        remove(spark, folder)
    return out
