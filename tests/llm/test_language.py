import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from urkunde.llm import lm_ppm, quality_mil, secret_scan
from urkunde.llm.common import remainder
from urkunde.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def check_scores(docs, got):
    train = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 7 != 2]
    c = collections.Counter(w for d in train for w in tokens(d.text))
    n, v = sum(c.values()) + len(train), len(c) + 1
    by = {r.doc_id: r for r in got}
    for d in docs:
        r, own = by[d.doc_id], tokens(d.text)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(train) + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(base) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(own) + 1, sum(c[w] > 0 for w in own) + 1)
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 7 == 2) and r.score < 0


def test_scores_against_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check_scores(docs, QUERIES["op2_lm_ppm"](spark, SF).collect())


def plain_model(texts):
    """From a context to its counts, in dictionaries; the context's bytes are padded with the end on the left."""
    model = collections.defaultdict(collections.Counter)
    for t in texts:
        whole = b"\xff" * 5 + t + b"\xff"
        for i in range(5, len(whole)):
            for k in range(6):
                model[whole[i - k : i]][whole[i]] += 1
    return model


def plain_probability(model, context, symbol):
    """Partial matching by its definition: escapes by distinct symbols, exclusion by freeing the shorter context's share of them."""
    counts = model.get(context)
    if counts is None:
        return plain_probability(model, context[1:], symbol) if context else 1 / 256
    n, d = sum(counts.values()), len(counts) if len(counts) < 256 else 0
    if symbol in counts:
        return counts[symbol] / (n + d)
    below = (lambda x: plain_probability(model, context[1:], x)) if context else lambda x: 1 / 256
    return d / (n + d) * below(symbol) / (1 - sum(map(below, counts)))


@pytest.mark.parametrize("size", [lm_ppm.SHARD, 300])
def test_scores_against_plain_partial_matching(spark, monkeypatch, size):
    """Also with so small shards that there are many."""
    monkeypatch.setattr(lm_ppm, "SHARD", size)
    rng = np.random.default_rng(5)
    words = ["the", "cat", "dög", "中文", "sat", "on", "mat", "\x00", "Ünder", "x" * 9]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 12))))) for i in range(60)] + [(60, None), (61, "unseen ÿ☃ q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    lower = [(t or "").encode().lower() for _, t in rows]
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    model = plain_model([lower[i] for i in train])
    for r in lm_ppm.score(df, remainder("doc_id", 7) == 2).collect():
        whole = b"\xff" * 5 + lower[r.doc_id] + b"\xff"
        want = sum(math.log10(plain_probability(model, whole[i - 5 : i], whole[i])) for i in range(5, len(whole)))
        assert r.score == pytest.approx(want, rel=1e-4, abs=1e-4), r


def test_plain_model_is_a_distribution():
    model = plain_model([b"the cat sat on the mat", b"the dog"])
    for context in (b"he ca", b"zz th", b"\xff\xff\xff\xff\xff", b"qqqqq"):
        assert sum(plain_probability(model, context, s) for s in range(256)) == pytest.approx(1)


def test_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 40, 5000))
    table = lm_ppm.Hash(keys, np.arange(len(keys)))
    hit, value = table.get(keys)
    assert hit.all() and (value == np.arange(len(keys))).all()
    assert not table.get(keys + (1 << 41))[0].any()
    assert not lm_ppm.Hash(keys[:0], keys[:0]).get(keys)[0].any()


def test_scoring_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 30000, "c"), (None, "x" * 100, "d"), (4, "é\x00ü word", "e"), (5, "same", "f"), (5, "same", "g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = lm_ppm.score(df, F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) for r in got)
    same = [r for r in got if r.doc_id == 5]
    assert same[0] == same[1]
    everything_out = lm_ppm.score(df, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.base_score) for r in everything_out)
    assert lm_ppm.score(df.limit(0), F.lit(False)).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op4_quality_mil"](spark, sf).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and len(held) > 50
    assert sum(p == y for p, y in held) / len(held) >= 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_gradients():
    rng = np.random.default_rng(3)
    model = quality_mil.train([rng.integers(0, 9, (2, quality_mil.FEATURES)) for _ in range(4)], np.array([0, 1, 0, 1]))
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, sizes, y = rng.random((7, quality_mil.FEATURES)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, sizes)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = model.gradients(x, sizes, y)
    for k, w in model.weights.items():
        i = tuple(rng.integers(0, n) for n in w.shape)
        was, step = w[i], 1e-6
        w[i] = was + step
        up = loss()
        w[i] = was - step
        down = loss()
        w[i] = was
        assert g[k][i] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_quality_against_a_plain_forward_pass(spark):
    """Scores of whole texts, passage by passage, from the model that the query's function learns."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = remainder("doc_id", 4) == 2
    model = quality_mil.fit(docs, labels.filter(~out), "doc_id", "text", "quality")
    w = {k: v.astype(float) for k, v in model.weights.items()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality_mil.classify(docs, labels, out).collect()[:40]:
        raw, encoded, weights = texts[r.doc_id].encode(), [], []
        n = max(1, len(raw) // 512)
        for i in range(n):
            x = np.zeros(512)
            for j in range(i * 512, (i + 1) * 512 if i < n - 1 else len(raw)):
                x[raw[j]] += 1
                if j:
                    x[256 + ((raw[j - 1] * 2654435761 + raw[j] * 40503) >> 7) % 256] += 1
            x = np.sqrt(np.concatenate([x[:256] / max(1, x[:256].sum()), x[256:] / max(1, x[256:].sum())]))
            h = np.tanh(x @ w["E"] + w["e"])
            encoded.append(h)
            weights.append(math.exp(float((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"])))
        z = sum(h * a for h, a in zip(encoded, weights, strict=True)) / sum(weights)
        assert r.score == pytest.approx(1 / (1 + math.exp(-float(z @ w["c"] + w["b"][0]))), abs=1e-4)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (None, "text " * 40000, "q"), (3, "a", "q"), (3, "a", "q")], "doc_id bigint, text string, score string")
    kind = "doc_id bigint, quality int"
    for rows in ([], [(1, 1)], [(1, 1), (2, 0), (3, 1), (None, 0), (2, None), (3, 0)]):
        got = quality_mil.classify(docs, spark.createDataFrame(rows, kind), F.lit(False)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality_mil.classify(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], kind), F.lit(False)).count() == 0


def brute_spans(text):
    found = []
    for k, (pattern, least) in enumerate(
        [
            (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
            (r"(AKIA[A-Z0-9]+)", 20),
            (r"([0-9a-f]+)", 24),
        ]
    ):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return sorted(found)


def test_secrets_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    hits = 0
    for r in QUERIES["op8_secret_scan"](spark, "/root/testdata/sf0.01").collect():
        want = brute_spans(docs[r.doc_id])
        hits += len(want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in want) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(secret_scan.joined(want).encode()).hexdigest()
        assert set(secret_scan.joined(want).split(",")) <= set(r.spans.split(","))
    assert hits > 10


def test_secret_kinds():
    key = "AKIA" + "IOSFODNN7EXAMPLE"
    t = f"x {key} Password: 'hunter22' API_KEY=abc token==zz secret = s3cr3t-1 " + "0123456789abcdef" * 2 + " ſecret=abcdefg toKen:abcdef"
    assert secret_scan.base_spans(t) == brute_spans(t)
    novel = 'authorization header "Xk9mQz4LwP7vRt2NbYh5Jd8S" and ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz after secret'
    spans = secret_scan.novel_spans(novel, [])
    assert [novel[s:e] for s, _, e in spans] == ["Xk9mQz4LwP7vRt2NbYh5Jd8S"]
    repeated = "token Xk9mQz4LwP7vRt2NbYh5Jd8S " * 5
    assert secret_scan.novel_spans(repeated, []) == []


PLANTED = [
    ("authorization header Xk9mQz4LwP7vRt2NbYh5Jd8S sent", ["Xk9mQz4LwP7vRt2NbYh5Jd8S"]),
    ("Bearer  eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9xQ7 and so on", ["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9xQ7"]),
    ("the credential is 9F86D081884C7D659A2FEAA0C55AD015 for now", ["9F86D081884C7D659A2FEAA0C55AD015"]),
    ("token Xk9mQz4LwP7vRtsecretNbYh5Jd8SqW3eR6tY9uI1oP", ["NbYh5Jd8SqW3eR6tY9uI1oP"]),  # a sensitive word inside
    ("secret ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", []),  # the identifiers explain it
    ("no such word Xk9mQz4LwP7vRt2NbYh5Jd8S here", []),
    ("token Xk9mQz4LwP7vRt2NbYh5Jd8S again Xk9mQz4LwP7vRt2NbYh5Jd8S", []),  # the text around explains it
    ("token = Xk9mQz4LwP7vRt2NbYh5Jd8S", []),  # a base span already
    ("token " + "x" * 60 + " Xk9mQz4LwP7vRt2NbYh5Jd8S", []),  # too far away
]


def brute_novel(text):
    """All substrings that are whole runs, or what follows the last sensitive word inside; measured one by one."""
    out, base = [], brute_spans(text)
    ends = [e for e in range(len(text) + 1) for w in SENSITIVE if text[:e].lower().endswith(w)]
    letter = lambda i: 0 <= i < len(text) and re.match(r"[A-Za-z0-9+/_=-]", text[i])
    for s in range(len(text)):
        if letter(s) and not letter(s - 1):
            e = s
            while letter(e):
                e += 1
            before = [w for w in ends if s - secret_scan.REACH <= w <= e - 16]
            if e - s < 16 or not before:
                continue
            at = max(s, *before, -1)
            value = text[at:e]
            if any(x < e and y > at for x, _, y in base) or sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", r"\d")) < 2:
                continue
            around = text[max(0, at - secret_scan.AROUND) : at] + text[e : e + secret_scan.AROUND]
            if len(value) >= 64:
                n = collections.Counter(value)
                bits = -sum(x / len(value) * math.log2(x / len(value)) for x in n.values())
            else:
                bits = 8
            if secret_scan.added_bytes(value, around) >= 0.8 * len(value) * bits / 8:
                out.append((at, 3, e))
    return out


SENSITIVE = ["passw", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "authorization", "signature"] + [f"{a}{b}key" for a in ("private", "access") for b in ("", "_", "-")]


def test_novelty_decides(spark):
    rows = [(i, t) for i, (t, _) in enumerate(PLANTED)] + [(100, " . ".join(t for t, _ in PLANTED)), (101, "secret " * 30 + "Xk9mQz4LwP7vRt2NbYh5Jd8S")]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i, t in rows:
        base = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(secret_scan.joined(base).encode()).hexdigest()
        spans = sorted(base + brute_novel(t))
        assert got[i].spans == secret_scan.joined(spans), t
        assert got[i].added_bytes == ",".join(str(secret_scan.added_bytes(t[s:e], t[max(0, s - 512) : s] + t[e : e + 512])) for s, _, e in spans)
    for i, (t, want) in enumerate(PLANTED):
        assert [t[s:e] for s, k, e in brute_novel(t)] == want, t
    assert sum("novel" in r.spans for r in got.values()) >= 4


def test_secrets_in_linear_time():
    began = time.process_time()
    secret_scan.novel_spans("secret token " * 400_000 + "Xk9mQz4LwP7vRt2NbYh5Jd8S", [])
    secret_scan.novel_spans("token" * 1_000_000, [])
    assert time.process_time() - began < 10


def test_secret_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "token = " * 20000, 0), (3, "secret " * 20000 + "a" * 100000, 0), (4, "é token = abcdefgh", 0), (4, "é token = abcdefgh", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    got = secret_scan.scan(df).collect()
    assert len(got) == 6 and [r.spans for r in got if r.doc_id == 4] == ["assign:2:18"] * 2
    assert secret_scan.scan(df.limit(0)).count() == 0
