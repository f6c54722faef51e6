"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by the frequencies of its bytes and byte pairs and one
tanh layer; a gated attention, learnt from the labels of whole documents, weighs the passages, and a logistic
layer scores the weighted sum of their encodings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, strings

#: Bytes of a passage; the last one takes the rest.
PASSAGE = 512
#: Frequencies of bytes, and of byte pairs by their hash.
BYTES, PAIRS = 256, 256
FEATURES = BYTES + PAIRS
HIDDEN, GATE = 32, 16
#: Labelled documents of either label that training sees at most, those of the least md5 of their id.
SAMPLE = 1500
#: Passages that the sampled documents of either label have at most together. Documents are taken whole, in that order; one
#: that does not fit any more is left out.
SAMPLE_PASSAGES = 20_000
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.003, 1e-4
#: Bytes that are encoded at once.
BLOCK = 1 << 20
THRESHOLD = 0.7


def passages(text: str) -> tuple[np.ndarray, int]:
    """Counts of a text's passages (passages x features) as one-dimensional places, and their number; an empty text has one, empty."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw) // PASSAGE)
    at = np.minimum(np.arange(len(raw)) // PASSAGE, n - 1) * FEATURES
    wide = raw.astype(np.int64)
    pairs = ((wide[:-1] * 2654435761 + wide[1:] * 40503) >> 7) % PAIRS
    return np.concatenate([at + wide, at[1:] + BYTES + pairs]), n


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of frequencies, for bytes and pairs apart."""
    out = counts.astype(np.float32)
    for part in (out[:, :BYTES], out[:, BYTES:]):
        part /= np.maximum(part.sum(1, keepdims=True), 1)
    return np.sqrt(out)


def count(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all passages of the texts and the number of passages of each."""
    places, sizes, first = [], [], 0
    for t in texts:
        at, n = passages(t)
        places.append(at + first * FEATURES)
        sizes.append(n)
        first += n
    return np.bincount(np.concatenate(places), minlength=first * FEATURES).reshape(first, FEATURES), np.array(sizes)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        s = (v * u) @ w["a"]
        top = np.repeat(np.maximum.reduceat(s, starts), sizes)
        exp = np.exp(s - top)
        attention = exp / np.repeat(np.add.reduceat(exp, starts), sizes)
        z = np.add.reduceat(attention[:, None] * h, starts)
        return {"h": h, "v": v, "u": u, "attention": attention, "z": z, "starts": starts, "p": sigmoid(z @ w["c"] + w["b"])}

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, sizes)
        d = (f["p"] - y) / len(y)
        dz = d[:, None] * w["c"]
        each = np.repeat(dz, sizes, axis=0)
        through = (each * f["h"]).sum(1)
        a = f["attention"]
        ds = a * (through - np.repeat(np.add.reduceat(a * through, f["starts"]), sizes))
        gate = ds[:, None] * w["a"]
        dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        dh = (a[:, None] * each + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "a": ((f["v"] * f["u"]).T @ ds), "c": f["z"].T @ d, "b": d.sum(keepdims=True)}

    def score(self, texts: list[str]) -> np.ndarray:
        counts, sizes = count(texts)
        return self.forward(features(counts), sizes)["p"].astype(float)


def train(counts: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """Fits the model to bags of passage counts by Adam; both labels weigh the same."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"E": normal(FEATURES, HIDDEN) * 4, "e": np.zeros(HIDDEN, np.float32), "V": normal(HIDDEN, GATE), "U": normal(HIDDEN, GATE), "a": normal(GATE), "c": normal(HIDDEN), "b": np.zeros(1, np.float32)}
    model, m, s = Model(w), {k: 0.0 for k in w}, {k: 0.0 for k in w}
    bags = [features(c) for c in counts]
    of = [np.flatnonzero(y == k) for k in (0, 1)]
    step = 0
    for epoch in range(EPOCHS):
        n = max(map(len, of))
        order = np.stack([rng.permutation(np.resize(rng.permutation(o), n)) for o in of], 1).ravel()
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            g = model.gradients(np.concatenate([bags[j] for j in own]), np.array([len(bags[j]) for j in own]), y[own].astype(np.float32))
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                w[k] -= (rate * (m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8) + DECAY * w[k])).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str) -> Model | float:
    """The model, or the only label as a number if there is but one, or 0.5 if there is none."""
    name = F.col(f"`{id_column}`")
    votes = labels.filter(F.col(label).isNotNull() & name.isNotNull()).groupBy(name.alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    order = F.md5(F.col("id").cast("string").cast("binary"))
    sample = [r for k in (0, 1) for r in votes.filter(F.col("y") == k).orderBy(order, "id").limit(SAMPLE).collect()]
    if len({r.y for r in sample}) < 2:
        return float(sample[0].y) if sample else 0.5

    def rows_of(rows: list) -> DataFrame:
        chosen = docs.sparkSession.createDataFrame(rows, votes.schema)
        return docs.select(name.alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "id")

    sizes = rows_of(sample).groupBy("id").agg(F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("n")).collect()
    of = {r.id: max(1, r.n // PASSAGE) for r in sizes}
    room, taken = [SAMPLE_PASSAGES] * 2, []
    for r in sample:
        if r.id in of and of[r.id] <= room[r.y]:
            room[r.y] -= of[r.id]
            taken.append(r)
    if len({r.y for r in taken}) < 2:
        return float(taken[0].y) if taken else 0.5

    def encode(batches):
        for batch in batches:
            bags = [count([t])[0].astype(np.uint16).tobytes() for t in strings(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(bags, pa.binary())], ["id", "y", "bag"])

    found = rows_of(taken).mapInArrow(encode, f"id {dict(docs.dtypes)[id_column]}, y int, bag binary")
    # A repeated id gives one bag.
    bags = sorted(found.groupBy("id").agg(F.max(F.struct("bag", "y")).alias("x")).select("id", "x.*").collect(), key=lambda r: str(r.id))
    y = np.array([r.y for r in bags])
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    return train([np.frombuffer(r.bag, np.uint16).reshape(-1, FEATURES) for r in bags], y)


def classify(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Adds held_out, score (0 to 1, higher: label 1 is likelier) and predicted (1 if score >= threshold).

    held_out is an expression on the id; labels of such ids are not learnt from. Of an id labelled more than
    once the mean label counts. Null and empty texts are one empty passage. With a single label in the
    training rows, or none, every score is that label or 0.5. Repeated rows are scored alike; an empty table
    stays empty; a kept column named like a new one is replaced. Training sees at most SAMPLE documents of
    either label with at most SAMPLE_PASSAGES passages together, and all passages of these; scoring sees every
    passage of every row.
    """
    model = fit(docs, labels.filter(~F.coalesce(held_out, F.lit(False))), id_column, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    marked = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))

    def make():
        m = shared.value

        def function(batch):
            scores: list[float] = []
            waiting: list[str] = []
            size = 0
            for t in strings(batch, text):
                waiting.append(t)
                size += len(t)
                if size > BLOCK:
                    scores += m.score(waiting).tolist() if isinstance(m, Model) else [m] * len(waiting)
                    waiting, size = [], 0
            if waiting:
                scores += m.score(waiting).tolist() if isinstance(m, Model) else [m] * len(waiting)
            return [scores, [int(x >= threshold) for x in scores]]

        return function

    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("held_out", "score", "predicted")]
    return map_batches(marked, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make, [*kept, "held_out"])
