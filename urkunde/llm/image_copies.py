"""Cropped and edited copies of images by local descriptors.

Corners are found at several scales, each gets an orientation from its patch's centre of mass and a binary
descriptor from intensity tests that are turned with it. Descriptors meet in hash tables, each over KEY of their
bits: two that differ in 16 of 256 bits meet in one of the tables with a chance of 0.94, in DISTANCE bits of 0.69. A
copy shares many more corners than the AGREEING it needs, so few copies are lost; tests measure the share against
comparing all descriptors. A query and a stored image whose matched corners agree on one change of scale, angle and
place are copies.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_groups, map_batches, may_have, remove, shrink, staged, work_dir

#: Factors between image sizes, and how many sizes.
STEP, LEVELS = 1.25, 4
#: Corners that are described: all local maxima of the response above this share of the image's largest.
RESPONSE = 0.08
RADIUS = 10
#: Matched descriptors may differ in DISTANCE bits. Tables, and the bits of each.
BITS, DISTANCE = 256, 24
TABLES, KEY = 12, 24
#: Matches that must agree on one change, and how far they may stray: places in pixels, scale by a factor, angle in degrees.
AGREEING, STRAY, SCALE, ANGLE = 8, 4.0, 1.4, 20.0
#: Share of a match's distance from the first one by which it may stray from what the first one's corner says, and the
#: multiples of STRAY that are allowed while the change is fitted.
COARSE, FITS = 0.35, (3.0, 1.5, 1.0)
#: Digests of images that a task remembers.
SEEN = 1 << 20
#: Matches that are tried as the first one at once.
FIRSTS = 16
#: Descriptors of queries, and of images, that are held against each other at once, and pairs of them.
ASKED, CORNERS, PAIRS = 1 << 17, 1 << 14, 1 << 18


def tests() -> np.ndarray:
    """Pairs of places in a unit disc, from a fixed generator."""
    rng = np.random.default_rng(11)
    p = rng.normal(0, 0.45, (BITS, 2, 2))
    return p / np.maximum(1, np.linalg.norm(p, axis=2, keepdims=True) / 0.95)


TESTS = tests()
#: The tests turned by each of TURNS angles, as whole pixels (y and x; turns x tests x two places).
TURNS = 64


def turned() -> tuple[np.ndarray, np.ndarray]:
    angle = 2 * np.pi * np.arange(TURNS)[:, None, None] / TURNS
    y, x = TESTS[..., 0] * RADIUS, TESTS[..., 1] * RADIUS
    places = np.sin(angle) * x + np.cos(angle) * y, np.cos(angle) * x - np.sin(angle) * y
    return tuple(np.clip(np.round(p), -RADIUS, RADIUS).astype(np.int32) for p in places)


TURNED = turned()
#: The bits of each table's key.
KEYS = np.stack([np.random.default_rng(100 + i).permutation(BITS)[:KEY] for i in range(TABLES)])


def blurred(a: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        p = np.pad(a, 1, mode="edge")
        a = (p[:-2] + 2 * p[1:-1] + p[2:])[:, 1:-1] / 4
        p = np.pad(a, 1, mode="edge")
        a = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:])[1:-1] / 4
    return a


def resized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    y, x = (np.arange(h) + 0.5) * a.shape[0] / h - 0.5, (np.arange(w) + 0.5) * a.shape[1] / w - 0.5
    return sampled(a, *np.meshgrid(y, x, indexing="ij"))


def sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    y, x = np.clip(y, 0, a.shape[0] - 1.001), np.clip(x, 0, a.shape[1] - 1.001)
    i, j = y.astype(int), x.astype(int)
    u, v = y - i, x - j
    k, m = np.minimum(i + 1, a.shape[0] - 1), np.minimum(j + 1, a.shape[1] - 1)
    return (1 - u) * ((1 - v) * a[i, j] + v * a[i, m]) + u * ((1 - v) * a[k, j] + v * a[k, m])


def corners(a: np.ndarray) -> np.ndarray:
    """Places (y, x) of the local maxima of the corner response."""
    p = np.pad(a, 1, mode="edge")
    dy, dx = (p[2:, 1:-1] - p[:-2, 1:-1]) / 2, (p[1:-1, 2:] - p[1:-1, :-2]) / 2
    yy, xx, xy = blurred(dy * dy, 2), blurred(dx * dx, 2), blurred(dx * dy, 2)
    r = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
    p = np.pad(r, 1, mode="constant", constant_values=-np.inf)
    top = np.max([p[i : i + r.shape[0], j : j + r.shape[1]] for i in range(3) for j in range(3) if (i, j) != (1, 1)], axis=0)
    b = RADIUS
    r[:b], r[-b:], r[:, :b], r[:, -b:] = 0, 0, 0, 0
    if r.size == 0 or r.max() <= 1e-6:
        return np.zeros((0, 2))
    return np.argwhere((r > top) & (r > RESPONSE * r.max())).astype(float)


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners as (x, y, log scale, angle) in the image's own pixels, and their descriptors (32 bytes each)."""
    places, bits = [], []
    base = pixels.astype(float)
    for level in range(LEVELS):
        f = STEP**level
        h, w = int(base.shape[0] / f), int(base.shape[1] / f)
        if min(h, w) < 2 * RADIUS + 3:
            break
        a = blurred(resized(base, h, w) if level else base)
        at = corners(a)
        if not len(at):
            continue
        g = np.arange(-RADIUS, RADIUS + 1)
        oy, ox = np.meshgrid(g, g, indexing="ij")
        inside = (oy**2 + ox**2) <= RADIUS**2
        patch = a[at[:, 0].astype(int)[:, None] + oy[inside], at[:, 1].astype(int)[:, None] + ox[inside]]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2((patch * oy[inside]).sum(1), (patch * ox[inside]).sum(1))
        smooth = blurred(a, 2).astype(np.float32)
        turn = np.round(angle * TURNS / (2 * np.pi)).astype(int) % TURNS
        y, x = at[:, 0].astype(int)[:, None, None] + TURNED[0][turn], at[:, 1].astype(int)[:, None, None] + TURNED[1][turn]
        v = smooth.ravel()[y * w + x]  # corners keep RADIUS from the edges, and so do the tests
        bits.append(np.packbits(v[:, :, 0] < v[:, :, 1], axis=1))
        places.append(np.stack([(at[:, 1] + 0.5) * base.shape[1] / w, (at[:, 0] + 0.5) * base.shape[0] / h, np.full(len(at), level * np.log(STEP)), angle], 1))
    if not places:
        return np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(places), np.concatenate(bits)


def pgm(pixels: np.ndarray) -> bytes:
    """A grey image as a file of the binary PGM format."""
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def read_image(content: bytes | None) -> np.ndarray | None:
    """The grey pixels of a PGM or 8-bit PNG file without interlacing; None if it is neither."""
    try:
        if content[:2] == b"P5":
            _, w, h, _, rest = content.split(None, 4) if content[2:3] != b"#" else (None,) * 5
            head = len(content) - len(rest)
            body = content[head:] if len(rest) == int(w) * int(h) else content[-int(w) * int(h) :]
            return np.frombuffer(body, np.uint8).reshape(int(h), int(w))
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return read_png(content)
    except (TypeError, ValueError, IndexError, zlib.error):
        pass
    return None


def read_png(content: bytes) -> np.ndarray | None:
    at, data, head = 8, b"", None
    while at < len(content):
        n, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + n]
        head = body if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    w, h, depth, colour, interlaced = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        return None
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    before = np.zeros(w * channels, np.int64)
    for y in range(h):
        kind, row = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 2:
            row = row + before
        elif kind in (1, 3, 4):
            for x in range(w * channels):
                a = row[x - channels] if x >= channels else 0
                b, c = before[x], before[x - channels] if x >= channels else 0
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                row[x] = (row[x] + guess) & 255
        before = row & 255
        out[y] = before
    image = out.reshape(h, w, channels)
    return image[:, :, 0] if channels < 3 else (image[:, :, :3] @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)


def consensus(a: np.ndarray, b: np.ndarray) -> int:
    """The most matches (rows of corners of two images) that agree on one change of scale, angle and place; 0 if under AGREEING.

    Each match's corners tell a change. With those that roughly carry it out, the change is fitted by least squares,
    more and more closely. Every match is tried as the first one unless it agrees with a change found before. What
    agrees within STRAY pixels of one another in either image counts once.
    """
    if len(a) < AGREEING:
        return 0
    z_a, z_b = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    change = np.exp(b[:, 2] - a[:, 2] + 1j * (b[:, 3] - a[:, 3]))
    cell_a, cell_b = np.round(z_a / STRAY), np.round(z_b / STRAY)
    best, left, step = 0, np.arange(len(a)), max(1, min(FIRSTS, PAIRS // len(a)))
    while len(left):
        k, left = left[:step], left[step:]
        apart = change[None, :] / change[k, None]
        near = (np.abs(np.log(np.abs(apart))) <= np.log(SCALE)) & (np.abs(np.angle(apart)) <= np.radians(ANGLE))
        way = z_a[None, :] - z_a[k, None]
        fit = near & (np.abs(z_b[k, None] + change[k, None] * way - z_b[None, :]) <= STRAY + COARSE * np.abs(change[k, None] * way))
        for stray in FITS:
            n = np.maximum(fit.sum(1), 1)
            mean_a, mean_b = fit @ z_a / n, fit @ z_b / n
            spread = fit @ (np.abs(z_a) ** 2) - n * np.abs(mean_a) ** 2
            turn = (fit @ (np.conj(z_a) * z_b) - n * np.conj(mean_a) * mean_b) / np.maximum(spread, 1e-9)
            off = np.abs(turn[:, None] * (z_a[None, :] - mean_a[:, None]) + mean_b[:, None] - z_b[None, :])
            fit = near & (off <= stray * STRAY) & ((np.abs(turn) > 0.2) & (np.abs(turn) < 5))[:, None]
        counts = fit.sum(1)
        for row in np.argsort(-counts, kind="stable"):
            if counts[row] <= max(best, AGREEING - 1):
                break
            best = max(best, min(len(np.unique(cell_a[fit[row]])), len(np.unique(cell_b[fit[row]]))))
            left = left[~fit[row][left]]
    return best if best >= AGREEING else 0


def matches(pairs_a: np.ndarray, bits_a: np.ndarray, pairs_b: np.ndarray, bits_b: np.ndarray) -> int:
    """Agreeing matches between two images' corners, each with its nearest descriptor within DISTANCE."""
    if not len(bits_a) or not len(bits_b):
        return 0
    apart = np.bitwise_count(bits_a[:, None, :] ^ bits_b[None, :, :]).sum(2)
    nearest = apart.argmin(1)
    good = apart[np.arange(len(apart)), nearest] <= DISTANCE
    return consensus(pairs_a[good], pairs_b[nearest[good]])


#: A corner's place, as it is kept: level of the scale, and angle in 256ths of a turn.
PLACE = np.dtype([("x", "<f4"), ("y", "<f4"), ("level", "u1"), ("angle", "i1")])


def packed(at: np.ndarray) -> bytes:
    out = np.empty(len(at), PLACE)
    out["x"], out["y"], out["level"] = at[:, 0], at[:, 1], np.round(at[:, 2] / np.log(STEP))
    out["angle"] = (np.round(at[:, 3] * 128 / np.pi) + 128) % 256 - 128
    return out.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """Places as describe() gives them."""
    a = np.frombuffer(raw, PLACE)
    return np.stack([a["x"].astype(float), a["y"], a["level"] * np.log(STEP), a["angle"] * np.pi / 128], 1)


def keys_of(words: np.ndarray) -> list[np.ndarray]:
    """Of descriptors as 64-bit words: each table's keys."""
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), BITS // 8), axis=1)
    weights = (1 << np.arange(KEY)).astype(np.float32)  # whole numbers up to 2^24 are exact in it
    return [(bits[:, at].astype(np.float32) @ weights).astype(np.int32) for at in KEYS]


class Corners:
    """Corners of several images in one: the image's digest, place and descriptor of each."""

    def __init__(self, images: list[bytes], at: list[bytes], bits: list[bytes]):
        self.images = images
        self.owner = np.repeat(np.arange(len(images)), [len(x) * 8 // BITS for x in bits])
        self.at = unpacked(b"".join(at))
        self.words = np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITS // 64)
        self.keys = keys_of(self.words)


class Tables:
    """Hash tables (here: sorted keys) over the corners of queries."""

    def __init__(self, asked: Corners):
        self.asked = asked
        self.orders = [np.argsort(p).astype(np.int32) for p in asked.keys]
        self.sorted = [p[o] for p, o in zip(asked.keys, self.orders, strict=True)]
        self.words = np.ascontiguousarray(asked.words.T)

    def near(self, stored: Corners) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of a query's and an image's descriptor that meet in a table and differ in at most DISTANCE bits, and in how many."""
        code, columns = np.zeros(0, np.int64), np.ascontiguousarray(stored.words.T)
        for own, order, keys in zip(stored.keys, self.orders, self.sorted, strict=True):
            low = np.searchsorted(keys, own)
            n = np.searchsorted(keys, own, "right") - low
            met = np.flatnonzero(n)
            ends, i, codes = np.cumsum(n[met]), 0, [code]
            while i < len(met):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
                own_n = n[met[i:j]]
                b = np.repeat(met[i:j], own_n)
                a = order[np.arange(len(b)) + np.repeat(low[met[i:j]] - np.cumsum(own_n) + own_n, own_n)]
                apart = 0
                for w in range(BITS // 64):
                    apart = apart + np.bitwise_count(self.words[w][a] ^ columns[w][b])
                    keep = np.flatnonzero(apart <= DISTANCE)
                    a, b, apart = a[keep], b[keep], apart[keep]
                codes.append(a.astype(np.int64) * len(own) + b)
                i = j
            code = np.unique(np.concatenate(codes))  # pairs of near copies meet in many tables: they are kept once
        a, b = np.divmod(code, max(1, len(stored.owner)))
        return a, b, np.bitwise_count(self.asked.words[a] ^ stored.words[b]).sum(1, dtype=np.int64)

    def copies(self, stored: Corners) -> list[tuple[bytes, bytes, int]]:
        """(query, image, agreeing) of the pairs with at least AGREEING agreeing matches."""
        a, b, apart = self.near(stored)
        if not len(a):
            return []
        image = stored.owner[b]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (image[1:] != image[:-1])]))
        first = np.minimum.reduceat(apart * len(a) + np.arange(len(a)), start) % len(a)  # the image's nearest descriptor to each of the query's
        a, b = a[first], b[first]
        q, image = self.asked.owner[a], stored.owner[b]
        order = np.argsort(q * len(stored.images) + image, kind="stable")
        a, b, q, image = a[order], b[order], q[order], image[order]
        start = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (image[1:] != image[:-1])])) if len(a) else np.zeros(0, int)
        n = np.diff(np.concatenate([start, [len(a)]]))
        out = []
        for i, size in zip(start[n >= AGREEING].tolist(), n[n >= AGREEING].tolist(), strict=True):
            r, one, two = slice(i, i + size), self.asked.images[q[i]], stored.images[image[i]]
            if one != two and (count := consensus(self.asked.at[a[r]], stored.at[b[r]])):
                out.append((one, two, count))
        return out


def links(described: DataFrame) -> DataFrame:
    """query, image, agreeing: pairs that are copies. described: image (digest), asks, stored, at, bits.

    Queries are taken in blocks of about ASKED descriptors, and each block's tables go over all images where they
    are. Nothing is shuffled, and what is sent is bounded; the passes over the images grow with the queries.
    """
    spark = described.sparkSession
    folder = work_dir(spark, "links")
    asked = described.filter("asks").select("image", "at", "bits")
    blocks = -(-(asked.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]) // (ASKED * BITS // 8))
    kinds, schema = (pa.binary(), pa.binary(), pa.int32()), "query binary, image binary, agreeing int"
    spark.createDataFrame([], schema).write.parquet(folder)
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("image"), F.lit(blocks)) == block).toArrow().to_pydict()
        shared = spark.sparkContext.broadcast((own["image"], own["at"], own["bits"]))

        def run(batches, shared=shared):
            tables = Tables(Corners(*shared.value))
            for batch in batches:
                images, at, bits = (c.to_pylist() for c in batch.columns)
                ends, i, out = np.cumsum([len(x) * 8 // BITS for x in bits]), 0, []
                while i < len(images):
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CORNERS, "right")))
                    out += tables.copies(Corners(images[i:j], at[i:j], bits[i:j]))
                    i = j
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["query", "image", "agreeing"])

        described.filter("stored").select("image", "at", "bits").mapInArrow(run, schema).write.mode("append").parquet(folder)
        shared.destroy()
    out = cut(spark.read.schema(schema).parquet(folder).groupBy("query", "image").agg(F.max("agreeing").alias("agreeing")))
    remove(spark, folder)
    return out


def find(df: DataFrame, is_query: Column, id_column: str, content: str, is_stored: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (id, is_query, image, class_id, class_size, n_corners) for all rows of df, and links (query, image, agreeing)
    between their images. See search(). Only rows with is_stored (by default all) are searched.

    Files are read once and neither moved nor staged. A task describes equal pixels once."""
    spark, folders = df.sparkSession, []

    def described_once():
        seen: set[bytes] = set()

        def function(batch):
            out: list[list] = [[], [], []]
            for x in batch.column(content):
                raw = x.as_py()
                image = read_image(raw)
                pixels = b"file" + (raw or b"") if image is None else b"%d " % image.shape[1] + image.tobytes()
                digest = hashlib.sha256(pixels).digest()[:16]
                at, bits = (None, None) if digest in seen else describe(image) if image is not None else (np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                out[0].append(digest)
                out[1].append(None if at is None else packed(at))
                out[2].append(None if bits is None else bits.tobytes())
            return out

        return function

    flags = [F.coalesce(is_query, F.lit(False)).alias("is_query"), (F.lit(True) if is_stored is None else F.coalesce(is_stored, F.lit(False))).alias("is_stored")]
    own = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{content}`").alias(content), *flags)
    fields = [("image", T.BinaryType()), ("at", T.BinaryType()), ("bits", T.BinaryType())]
    rows = staged(map_batches(own, fields, described_once, ["id", "is_query", "is_stored"]), folders, "images")
    n_corners = F.max(F.expr(f"octet_length(bits) div {BITS // 8}").cast("int")).alias("n_corners")
    groups = rows.groupBy("image").agg(F.min(F.struct("id")).alias("first"), F.count("*").alias("n"), F.max("is_query").alias("asks"), F.max("is_stored").alias("stored"), n_corners)
    groups = staged(groups, folders, "groups")

    # Marked as queries and as searched are a few images more; exactly so below. Several tasks may have described one.
    described = rows.filter("bits is not null").select("image", "at", "bits")
    described = may_have(described, F.col("image"), F.col("image"), groups.filter("asks")).withColumnRenamed("may", "asks")
    described = may_have(described, F.col("image"), F.col("image"), groups.filter("stored")).withColumnRenamed("may", "stored")
    shrink(spark)
    found = links(described)
    found = found.join(groups.filter("asks").select(F.col("image").alias("query")), "query", "left_semi").join(groups.filter("stored").select("image"), "image", "left_semi")
    whole = groups.select("image", "n", F.col("first.id").alias("class_id"), "n_corners")
    out = cut(join_groups(rows.select("id", "is_query", "image"), whole, "image", "n").select("id", "is_query", "image", "class_id", F.col("n").alias("class_size"), "n_corners"))
    found = cut(found)
    for folder in folders:
        remove(spark, folder)
    return out, found


def search(df: DataFrame, is_query: Column, id_column: str, content: str, is_stored: Column | None = None) -> DataFrame:
    """One row for each row of df: the id, class_id (least id of the rows with the same pixels), class_size, is_query,
    n_corners, and for queries n_copies (other classes that are cropped or edited copies), best_copy (class_id of
    the one with the most agreeing matches) and best_agreeing; null for others.

    Rows with equal pixels are one class, described and searched for once; it is a query if one of its rows is.
    Files that cannot be read, and nulls, have no corners and are classes by their bytes. Ties go to the least
    class_id; a null id is the least. An empty table gives an empty result. Other columns are not read. Only classes
    with a row that is_stored are searched; a query is not a copy of its own class.
    """
    return summary(*find(df, is_query, id_column, content, is_stored)).drop("image").withColumnRenamed("id", id_column)


def summary(rows: DataFrame, found: DataFrame) -> DataFrame:
    """What search() tells of each row, beside its image."""
    names = rows.groupBy("image").agg(F.first("class_id").alias("class_id"))
    best = F.min(F.struct((-F.col("agreeing")).alias("less"), "class_id", "agreeing")).alias("best")
    best = found.join(names, "image").groupBy(F.col("query").alias("image")).agg(F.count("*").alias("n_copies"), best)
    return rows.join(best, "image", "left").select(
        "id",
        "image",
        "class_id",
        "class_size",
        "is_query",
        "n_corners",
        F.when(F.col("is_query"), F.coalesce("n_copies", F.lit(0))).alias("n_copies"),
        F.when(F.col("is_query"), F.col("best.class_id")).alias("best_copy"),
        F.when(F.col("is_query"), F.coalesce("best.agreeing", F.lit(0))).alias("best_agreeing"),
    )
