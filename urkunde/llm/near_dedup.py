"""Near duplicates by order min-hash.

A sketch holds, for one hash function, the KEEP least of a text's occurrence-labelled shingles in the order of
the text, so that two texts share it with a chance that follows their edit similarity. Texts that share one of
SKETCHES sketches are candidates. Candidates are verified by a banded alignment of their shingles, which alone
decides: the same shingles in another order are no link.

Groups can be very large, so candidates are not all pairs of a bucket. First each text is verified against the
most central text of each of its buckets (the one whose sketches are shared most). What that connects needs no
further pairs. Then the buckets that still hold more than one component are gone through in blocks: each task keeps
the components of its own texts, so that texts which a link has just connected are not aligned again, and passes
over pairs only by bounds that no link can miss (lengths, and counts of shingles by their hash). So the only links
that can be lost are those between texts that share no sketch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, give_back, join_groups, keep_rows, map_batches, may_have, release, remove, small_batches, staged, strings, text_of

WORDS = 5
SIMILARITY = 0.8
#: Texts of similarity 0.8 share a sketch with a chance of 0.8 ** KEEP, and none of all with about 4e-8.
SKETCHES, KEEP = 24, 3
#: Texts, and shingles, of a bucket that make a block; each task holds two blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Pairs with one hub that a task verifies.
HUB_PAIRS = 1024
#: Counts by hash that a task holds at once, and how many of them a text has.
COUNTS, LEAST_COUNTS, MOST_COUNTS = 1 << 22, 256, 1 << 14
#: Occurrences of a shingle, and shingles that an occurrence stands for, beyond which its places are kept as bits.
OFTEN = 64
#: Links of a task that are connected at once before they are passed on.
FOREST = 1 << 19

PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * PRIME)
_powers: list[np.ndarray] = []


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def shingles(text: str) -> np.ndarray:
    """Hashes of the text's runs of WORDS words in order (ASCII letters lower-cased); of all its words if there are fewer."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    if not _powers or len(_powers[0]) < len(raw):
        _powers[:] = [powers(max(len(raw), 1 << 16), PRIME), powers(max(len(raw), 1 << 16), INVERSE)]
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(raw.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(raw)], dtype=np.uint64)])
        words = mix((sums[end] - sums[start]) * _powers[1][start])
        n = max(1, len(words) - WORDS + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(WORDS, len(words))):
            out = mix(out + words[i : i + n] * np.uint64(2 * i + 1))
    return out


def sketch(text: str) -> tuple[list[int], int]:
    """Sketches, each mixed with its number, and the number of shingles; nothing for a text without words."""
    plain = shingles(text)
    if not len(plain):
        return [], 0
    labelled = plain
    own, where, times = np.unique(plain, return_inverse=True, return_counts=True)
    with np.errstate(over="ignore"):
        if len(own) < len(plain):
            order = np.argsort(where, kind="stable")
            which = np.empty(len(plain), np.uint64)
            which[order] = np.arange(len(plain)) - np.repeat(np.cumsum(times) - times, times)
            labelled = mix(plain + which * PRIME)
        keep = min(KEEP, len(plain))
        out = SEEDS.copy()
        step = max(1, PIECE // len(plain))
        for i in range(0, SKETCHES, step):
            value = mix(labelled[None, :] ^ SEEDS[i : i + step, None])
            at = np.sort(np.argpartition(value, keep - 1, axis=1)[:, :keep], axis=1)
            for k in range(keep):
                out[i : i + step] = mix(out[i : i + step] + plain[at[:, k]] * np.uint64(2 * k + 1))
    return out.view(np.int64).tolist(), len(plain)


def reaches(matched, a, b):
    """Whether that many matched shingles make texts of a and b shingles near duplicates."""
    return matched >= SIMILARITY * (a + b - matched)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The share of all shingles that an alignment in the same order matches: matched / (len(a) + len(b) - matched).

    The band holds every alignment of similarity SIMILARITY; pairs that cannot reach it by counts give 0.
    """
    if len(a) > len(b):
        a, b = b, a
    x, y = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not reaches(int(np.minimum(x[1][i], y[1][j]).sum()), len(a), len(b)):
        return 0.0
    # At most (1 - s) / (1 + s) of all shingles stay unmatched, and a match's places differ by no more than these.
    band = int((1 - SIMILARITY) / (1 + SIMILARITY) * (len(a) + len(b))) + 1
    places: dict[int, list[int]] = {}
    for k, s in enumerate(a.tolist()):
        places.setdefault(s, []).append(k)
    # Where a shingle is, as bits, for the few that recur often; else made when needed, as all of them have too many bits.
    often = {s: sum(1 << k for k in at) for s, at in places.items() if len(at) > max(OFTEN, len(a) // OFTEN)}
    ones = (1 << len(a)) - 1
    row = ones  # a zero bit for each step of the longest common subsequence
    width = (1 << (2 * band + 1)) - 1
    for k, s in enumerate(b.tolist()):
        if at := places.get(s):
            if m := often.get(s, 0):
                m &= width << (k - band) if k >= band else width >> (band - k)
            else:
                for p in at:
                    if abs(p - k) <= band:
                        m |= 1 << p
            u = row & m
            row = ((row + u) | (row - u)) & ones
    matched = len(a) - row.bit_count()
    return matched / (len(a) + len(b) - matched)


def node_of(text: Column) -> Column:
    """128 bits of a text's digest."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), the links. The pairs of an `a` are dealt to tasks by HUB_PAIRS, each of which gets its text once."""

    def make():
        def function(batch):
            out, last, own = [], None, None
            for a, b in zip(strings(batch, "text_a"), strings(batch, "text_b"), strict=True):
                if a != last:
                    last, own = a, shingles(a)
                out.append(similarity(own, shingles(b)) >= SIMILARITY)
            return [out]

        return function

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts"))
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    two = pairs.join(parts, "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    two = two.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    return map_batches(two.join(one, ["a", "part"]), [("near", T.BooleanType())], make, ["a", "b"]).filter("near").select("a", "b")


class Forest(dict):
    """Components of what has been linked: from each member to another on the way to the root."""

    def root(self, x):
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def link(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        self.setdefault(a, a), self.setdefault(b, b)
        self[max(a, b)] = min(a, b)


def stars(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) that connect the same: each task's components as stars around their least node."""

    def run(batches):
        forest = Forest()

        def out():
            found = [(x, r) for x in forest if (r := forest.root(x)) != x]
            forest.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in range(2)], ["a", "b"])

        for batch in batches:
            for a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                forest.link(a, b)
            if len(forest) > FOREST:
                yield out()
        if forest:
            yield out()

    return links.select("a", "b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that links lead to, by least neighbours and shortcuts until nothing changes."""
    spark, folders, spent = links.sparkSession, [], []
    links = staged(stars(links), folders, "links")
    links = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("a"), folders, "links")
    roots = staged(links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), spent, "roots")
    while True:
        near = links.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        stepped = roots.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        over = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = staged(stepped.join(over, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), folders, "roots")
        changed = not found.filter("root <> was").isEmpty()
        for folder in spent:
            remove(spark, folder)
        roots, spent = found.drop("was"), [folders.pop()]
        del near, stepped, over, found
        release(spark)
        if not changed:
            out = cut(roots)
            for folder in [*folders, *spent]:
                remove(spark, folder)
            return out


def block_links(left: list[tuple], right: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
    """Links between texts (node, root, text) of two blocks, or in one if both are the same, that connect what was not connected."""
    same = left is right
    rows = left if same else left + right
    names: dict[bytes, int] = {}
    root = np.array([names.setdefault(r[1], len(names)) for r in rows], int)
    if len(names) < 2:
        return
    texts = [shingles(r[2]) for r in rows]
    n = np.array([len(t) for t in texts])
    size = LEAST_COUNTS
    while size < min(MOST_COUNTS, n.max(), COUNTS // len(rows)):
        size *= 2
    counts = np.stack([np.bincount((t & np.uint64(size - 1)).astype(int), minlength=size) for t in texts]).astype(np.int32)
    first = 0 if same else len(left)
    for k in range(len(left)):
        other = np.arange(max(first, k + 1), len(rows))
        other = other[(root[other] != root[k]) & reaches(np.minimum(n[other], n[k]), n[other], n[k])]
        bound = np.concatenate([np.minimum(counts[other[i : i + BLOCK]], counts[k]).sum(1) for i in range(0, len(other), BLOCK)]) if len(other) else other
        fit = reaches(bound, n[other], n[k])
        for m in other[fit][np.argsort(-bound[fit], kind="stable")].tolist():
            if root[m] != root[k] and similarity(texts[k], texts[m]) >= SIMILARITY:
                root[root == root[m]] = root[k]
                yield rows[k][0], rows[m][0]


def blocks_of(n: Column, shingle_count: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK, shingle_count / BLOCK_SHINGLES)).cast("int")


def open_links(members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) within the buckets that hold more than one component; members: bucket, node, size.

    The texts of a large bucket's largest component are already connected, so their blocks are held against the blocks of
    the others only; so a bucket's cost is the number of its texts times that of those outside its largest component.
    """
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    buckets = own.groupBy("bucket").agg(F.count("*").alias("components"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "shingles", "root")).alias("most"))
    whole = blocks_of(F.col("n"), F.col("shingles"))
    rest = F.when(whole > 1, blocks_of(F.col("n") - F.col("most.n"), F.col("shingles") - F.col("most.shingles"))).otherwise(1)
    largest = F.when(whole > 1, blocks_of(F.col("most.n"), F.col("most.shingles"))).otherwise(0)
    buckets = buckets.filter("components > 1").select("bucket", "most.root", rest.alias("rest"), largest.alias("largest")).withColumnRenamed("root", "most")
    rows = rooted.join(buckets, "bucket").join(texts, "node")
    # Blocks from 0 on hold the rest, those behind them the largest component; a small bucket is one block.
    in_largest = (F.col("root") == F.col("most")) & (F.col("largest") > 0)
    at = F.xxhash64("node")
    rows = rows.withColumn("own", F.when(in_largest, F.col("rest") + F.pmod(at, F.greatest("largest", F.lit(1)))).otherwise(F.pmod(at, F.col("rest"))).cast("int"))
    others = F.when(in_largest, F.col("rest")).otherwise(F.col("rest") + F.col("largest"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "text")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches):
        give_back(__name__)
        key, left, right = None, [], []

        def out():
            found = list(block_links(left, left if key[1] == key[2] else right))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in range(2)], ["a", "b"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != row[:3]:
                    if key is not None:
                        yield out()
                    key, left, right = row[:3], [], []
                (left if row[3] == row[1] else right).append(row[4:])
        if key is not None:
            yield out()

    return rows.mapInArrow(run, "a binary, b binary")


def linked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root of all texts that are linked to another. nodes: node, id, size, sketches."""
    spark, folders = docs.sparkSession, []
    exploded = nodes.select("node", "size", F.explode("sketches").alias("bucket"))
    buckets = exploded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = staged(exploded.join(buckets, "bucket"), folders, "members")
    del exploded, buckets
    release(spark)

    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    tops = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("central", "node")).alias("top"))
    pairs = members.join(tops.select("bucket", F.col("top.node").alias("a")), "bucket").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    pairs = staged(pairs, folders, "pairs")
    del central, tops
    release(spark)

    own = docs.select(node_of(F.col("text")).alias("node"), "text")
    needed = members.select("node").distinct()
    own = may_have(own, F.col("node"), F.col("node"), needed).filter("may").select("node", "text").groupBy("node").agg(F.first("text").alias("text"))
    texts = staged(own.join(needed, "node", "left_semi"), folders, "texts")
    del own, needed
    release(spark)

    with small_batches(spark):
        links = staged(verified(pairs, texts), folders, "links")
    release(spark)
    roots = components(links)
    release(spark)
    with small_batches(spark):
        more = staged(open_links(members.drop("n"), roots, texts), folders, "links")
    release(spark)
    found = components(links.unionByName(more)) if not more.isEmpty() else roots
    for folder in folders:
        remove(spark, folder)
    return found


def rows_of_classes(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, node, class_id, class_size, kept for each row of df."""
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(f"`{id_column}`").alias("id"), text_of(text).alias("text"))

    def make():
        def function(batch):
            found = [sketch(t) for t in strings(batch, "text")]
            return [[x[k] for x in found] for k in range(2)]

        return function

    folders: list[str] = []
    own = docs.withColumn("node", node_of(F.col("text"))).withColumn("row", F.monotonically_increasing_id())
    rows = staged(map_batches(own, [("sketches", T.ArrayType(T.LongType())), ("size", T.LongType())], make, ["id", "node", "row"]), folders, "sketches")
    # Equal texts are one node; its row of least id stands for it.
    nodes = rows.groupBy("node").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("n"), F.first("sketches").alias("sketches"), F.first("size").alias("size"))
    nodes = staged(nodes, folders, "nodes")
    release(spark)
    roots = linked(docs.select("text"), nodes.select("node", "size", "sketches"))
    found = nodes.select("node", "first", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = found.groupBy("root").agg(F.min("first").alias("class"), F.sum("n").alias("class_size"))
    found = found.join(whole, "root").select("node", "n", "class", "class_size")
    out = cut(
        join_groups(rows.select("node", "id", "row"), found, "node", "n").select(
            "id", "node", F.col("class.id").alias("class_id"), "class_size", (F.col("row") == F.col("class.row")).alias("kept")
        )
    )
    del found, whole
    for folder in folders:
        remove(spark, folder)
    release(spark)
    return out


def classes(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: the id, class_id, class_size, kept.

    Texts are linked when an alignment of their runs of WORDS words matches at least SIMILARITY of them; a class
    is what links and equal texts connect. class_id is its least id (null is the least), class_size its number
    of rows, and the row that is kept is that of class_id; of rows with the same id and text, one. Null counts as
    empty; texts without words are linked to equal ones only. An empty table gives an empty result. Other
    columns are not read.
    """
    return rows_of_classes(df, id_column, text).drop("node").withColumnRenamed("id", id_column)


def deduplicate(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that are kept, with df's columns; see classes()."""
    found = rows_of_classes(df, id_column, text)
    return keep_rows(df, found.filter("class_size > 1").select("id", "node", "kept"), id_column, node_of(text_of(text)))
