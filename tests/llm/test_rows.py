import collections
import itertools

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from urkunde.llm import exact_dedup, image_copies, mixture, near_dedup, url_rules
from urkunde.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert got == sorted(repr([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.COM/en/71?x", "http://com/en/", "http://xcom/en/1", "ftp://example.net?/de/8", "http://example.net/de/8#f", "http://a.example.net/de/9", "http://net/de", "http://b.org/es/",
        "http://example.com./en/7", "http://e.com:80/en/1", "x://y://z/en/", "http://com-x/en/1", "http://de.com/en/7",
    ]
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    got = {r.page_id: r for r in url_rules.judge(df, spark.createDataFrame(rules, "verdict string, rule string")).collect()}
    for i, u in enumerate(urls):
        at = (u or "").find("://")
        rest = u[at + 3 :] if u and at >= 0 else ""
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(r), r, v) for v, r in rules if path.startswith(r[r.index("/") :]) and (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")]))]
        best = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[1], best[2]), u
    none = spark.createDataFrame([], "verdict string, rule string")
    assert {r.verdict for r in url_rules.judge(df, none).collect()} == {"allow"}
    assert url_rules.judge(df.limit(0), spark.createDataFrame(rules, "verdict string, rule string")).count() == 0


def test_many_nested_rules(spark):
    """Random hosts and paths with nested rules, over many ranges and with one very frequent host."""
    rng = np.random.default_rng(12)
    label = lambda: str(rng.choice(["a", "b", "co", "x"]))
    host = lambda: ".".join(label() for _ in range(int(rng.integers(1, 4))))
    path = lambda: "".join(str(rng.choice(["/", "a", "b", "é", "\U0010ffff"])) for _ in range(int(rng.integers(0, 6))))
    rules = sorted({(host(), "/" + path()) for _ in range(60)} | {(host(), "") for _ in range(6)})
    rules = [("block" if i % 2 else "allow", h + p) for i, (h, p) in enumerate(rules)] + [("block", rules[0][0] + rules[0][1])]
    urls = [f"http://{host()}/{path()}" for _ in range(300)] + ["http://hot.a.b/ab"] * 300 + ["http://", "http://.", "http://a..b/a"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    verdicts = {}
    for v, r in rules:
        verdicts[r] = "block" if "block" in (v, verdicts.get(r)) else v
    for r in url_rules.judge(df, spark.createDataFrame(rules, "verdict string, rule string")).collect():
        cut = lambda x: x.partition("/")[0]
        fits = [x for x in verdicts if (r.host == cut(x) or r.host.endswith("." + cut(x))) and r.path.startswith(x[len(cut(x)) :])]
        best = max(fits, key=lambda x: (len(x), len(cut(x)), x), default=None)
        assert (r.rule, r.verdict) == (best, verdicts.get(best, "allow")), urls[r.page_id]


COPIES = [(1, "a"), (3, "a"), (2, "a"), (4, "b"), (4, "b"), (None, "c"), (5, "c"), (6, None), (7, ""), (None, "d"), (8, "long " * 30000), (9, "long " * 30000)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, weak):
    """Also with a digest by which different texts collide."""
    df = spark.createDataFrame([(i, t, "x") for i, t in COPIES], "doc_id bigint, text string, kept string")
    digest = (lambda t: F.length(t)) if weak else exact_dedup.sha256
    got = exact_dedup.duplicates(df, digest=digest).collect()
    groups = collections.defaultdict(list)
    for i, t in COPIES:
        groups[t or ""].append(i)
    want = sorted((i or 0, max(x or 0 for x in groups[t or ""]), len(groups[t or ""])) for i, t in COPIES)
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.text or "" for r in kept.collect()) == sorted(groups)
    assert exact_dedup.duplicates(df.limit(0)).count() == exact_dedup.deduplicate(df.limit(0)).count() == 0


def test_mixture(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{i % 7}", "x") for i in range(400)]
    rows += [(None, None, None, "x"), (400, "one two", None, "x"), (400, "one two", None, "x"), (401, "", "empty", "x"), (402, "w " * 20000, "big", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, taken string")
    got = mixture.plan(df).collect()
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, left = sum(sizes.values()), {}, set(names)
    while True:  # share, stop those above, share again
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] > 3 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in above}
        left -= above
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert len(r.positions) == -(-r.taken // r.size) if r.size else r.taken == 0
        assert all(0 <= p <= 1 for p in r.positions) and sorted(r.positions) == r.positions
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    mixed = mixture.mix(df)
    assert mixed.columns == df.columns and mixed.collect() == mixture.mix(df).collect()
    assert mixture.plan(df.limit(0)).count() == mixture.mix(df.limit(0)).count() == 0


def test_mixture_ties(spark):
    """Rows of one id and one size, and of no id, have one order whatever the layout."""
    rows = [(i, f"a b c{k}", "s", k % 3) for i in (None, 5) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int")
    other = spark.createDataFrame(rows[::-1], df.schema).repartition(7)
    assert mixture.mix(df).collect() == mixture.mix(other).collect()
    first = F.substring(F.md5(F.md5("text")), 1, 2)
    assert df.filter("doc_id is null").select(first).distinct().count() > 50  # rows without an id are spread over parts


def test_moments(spark):
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(float(s), k) for s in shares for k in range(3)], "s double, k int")
    for r in df.select("s", "k", mixture.moment(F.col("s"), F.col("k")).alias("t")).collect():
        (_, a), (_, b) = mixture.SCHEDULES[r.k]
        assert a * r.t + (b - a) * r.t**2 / 2 == pytest.approx(r.s)


def shingled(text):
    words = text.lower().split()
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def is_near(a, b):
    """By the whole table of the longest common subsequence; counts first, as they are quicker."""
    both = sum((collections.Counter(a) & collections.Counter(b)).values())
    if not both or both < 0.8 * (len(a) + len(b) - both):
        return False
    n = common_subsequence(a, b)
    return n >= 0.8 * (len(a) + len(b) - n)


def test_near_against_brute_force(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(vocabulary, 150)) for _ in range(25)]
    shared = " ".join(rng.choice(vocabulary, 70))
    texts = []
    for b in base:
        words = b.split()
        texts.append(b)
        for _ in range(int(rng.integers(0, 8))):
            own = list(words)
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(0, len(own)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(own))
        texts.append(shared + " " + " ".join(rng.choice(vocabulary, 40)))
    blocks = [" ".join(rng.choice(vocabulary, 40)) for _ in range(6)]
    texts += [" ".join(blocks), " ".join(blocks[3:] + blocks[:3])]  # alike as sets, not in order
    line = " ".join(rng.choice(vocabulary, 10))
    texts += [base[0] + " " + line, base[0] + (" " + line) * 20, (line + " ") * 60, (line + " ") * 62]  # lines that repeat
    texts += ["", None, "one two", "one two", "x " * 700, "y " * 5000]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1, 2), (None, "alone here", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, class_id string, kept int, class_size int")
    got = near_dedup.classes(df).collect()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    runs = [shingled(t or "") for _, t, *_ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or is_near(runs[i], runs[j]):
                parent[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        members[find(i)].append(-1 if d is None else d)
    want = sorted((d, min(m), len(m)) for m in members.values() for d in m)
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(members)
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns and kept.count() == len(members)
    assert near_dedup.classes(df.limit(0)).count() == near_dedup.deduplicate(df.limit(0)).count() == 0


def test_near_in_blocks(spark, monkeypatch):
    """One bucket of many texts that are not linked to its hub: all pairs of blocks are gone through."""
    rng = np.random.default_rng(16)
    words = [f"w{i}" for i in range(120)]
    at = near_dedup.shingles(" ".join(words))
    chain = []
    for _ in range(60):  # each text differs from the one before by one word
        words[int(rng.integers(0, 120))] = f"v{rng.integers(0, 10**9)}"
        chain.append(" ".join(words))
    nodes = [f"{i:02d}".encode() for i in range(60)]
    members = spark.createDataFrame([(7, x, len(at)) for x in nodes], "bucket long, node binary, size long")
    texts = spark.createDataFrame(list(zip(nodes, chain, strict=True)), "node binary, text string")
    roots = spark.createDataFrame([], "node binary, root binary")
    want = {frozenset(p) for p in itertools.combinations(range(60), 2) if is_near(shingled(chain[p[0]]), shingled(chain[p[1]]))}
    for size in (1024, 16):
        monkeypatch.setattr(near_dedup, "BLOCK", size)
        got = [(int(r.a), int(r.b)) for r in near_dedup.open_links(members, roots, texts).collect()]
        assert {frozenset(p) for p in got} <= want
        forest = near_dedup.Forest()
        for p in got:
            forest.link(*p)
        assert len({forest.root(i) for i in range(60)}) == 1
    # With a large component that is known, its texts are held against the others only.
    known = spark.createDataFrame([(x, nodes[5]) for x in nodes[5:50]], "node binary, root binary")
    got = [(int(r.a), int(r.b)) for r in near_dedup.open_links(members, known, texts).collect()]
    assert {frozenset(p) for p in got} <= want and not any(5 <= a < 50 and 5 <= b < 50 for a, b in got)
    forest = near_dedup.Forest()
    for p in [*got, *((5, i) for i in range(6, 50))]:
        forest.link(*p)
    assert len({forest.root(i) for i in range(60)}) == 1


def test_order_decides():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 1 << 60, 100).astype(np.uint64) for _ in range(12)]
    whole = np.concatenate(blocks)
    assert near_dedup.similarity(whole, whole) == 1
    assert near_dedup.similarity(whole, np.concatenate([blocks[i] for i in rng.permutation(12)])) < 0.8


def test_alignment():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a = rng.integers(0, 40, int(rng.integers(5, 60))).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, 4))):
            k = int(rng.integers(0, len(b)))
            b[k : k + int(rng.integers(0, 3))] = rng.integers(0, 40, int(rng.integers(0, 3))).tolist()
        n = common_subsequence(a, b)
        got = near_dedup.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        ordered = n / (len(a) + len(b) - n)
        assert (got >= 0.8) == (ordered >= 0.8) and (got < 0.8 or got == ordered)


def picture(seed, h=96, w=96):
    rng = np.random.default_rng(seed)
    smooth = image_copies.resized(rng.uniform(0, 255, (12, 12)), h, w) + image_copies.resized(rng.uniform(-60, 60, (24, 24)), h, w)
    return np.clip(smooth, 0, 255).round().astype(np.uint8)


def test_images(spark):
    rng = np.random.default_rng(9)
    base = [picture(i) for i in range(12)]
    edits = [
        lambda a: a[12:84, 20:90],
        lambda a: np.clip(a * 0.8 + 30, 0, 255),
        lambda a: np.clip(a + rng.normal(0, 4, a.shape), 0, 255),
        lambda a: np.rot90(a),
        lambda a: image_copies.resized(a.astype(float), 120, 120),
    ]
    rows = [(100 + i, image_copies.pgm(b), "x") for i, b in enumerate(base)]
    rows += [(i, image_copies.pgm(np.asarray(edits[i % 5](base[i]))), "x") for i in range(10)]
    rows += [(50, None, "x"), (51, b"", "x"), (52, b"junk", "x"), (53, rows[0][1], "x"), (None, image_copies.pgm(np.zeros((40, 40))), "x"), (54, b"P5 9 9 255\nshort", "x")]
    df = spark.createDataFrame(rows, "id bigint, file binary, class_id string")
    got = {r.id: r for r in image_copies.search(df, F.col("id") < 10, "id", "file").collect()}
    for i in range(10):
        assert got[i].n_copies == 1 and got[i].best_copy == (53 if i == 0 else 100 + i) and got[i].best_agreeing >= image_copies.AGREEING, i
    assert (got[53].class_id, got[53].class_size, got[100].class_id) == (53, 2, 53)
    assert got[100].n_copies is None and got[50].class_id == 50 and got[50].class_size == 2 and got[50].n_corners == 0
    assert image_copies.search(df.limit(0), F.lit(True), "id", "file").count() == 0


def test_image_ties_and_clashes(spark):
    """Two equally good copies: the one of the least id; ids as text; columns named like the result's; a large picture."""
    a = picture(3)
    rows = [(x, image_copies.pgm(p), "x", 1) for x, p in (("q", a[8:90, 8:90]), ("c", a), ("b", a), ("d", np.rot90(a)))]
    rows += [("large", image_copies.pgm(np.kron(picture(4, 160, 160), np.ones((6, 6)))), "x", 1)]
    df = spark.createDataFrame(rows, "image string, file binary, class_id string, n_copies int")
    got = {r.image: r for r in image_copies.search(df, F.col("image") == "q", "image", "file").collect()}
    assert (got["q"].n_copies, got["c"].class_id, got["c"].class_size) == (2, "b", 2) and got["q"].best_copy in ("b", "d")
    assert got["large"].n_corners > 0
    none = image_copies.search(df, F.col("image") == "q", "image", "file", F.col("image") == "large").collect()
    assert [r.n_copies for r in none if r.image == "q"] == [0]


def test_image_links_against_brute_force(spark):
    """The query's own pictures and edits against comparing all descriptors of all pairs; the share that is found."""
    from urkunde.llm import queries

    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").limit(60).collect()
    made = {r.vec_id: queries.drawn(r.embedding) for r in vectors}
    assert all(a.shape == (96, 96) for a in made.values())
    sets = {(i, None): image_copies.describe(a) for i, a in made.items()}
    ids = list(made)
    for k, i in enumerate(ids):
        e = queries.EDITS[k % len(queries.EDITS)]
        sets[i, e] = image_copies.describe(np.asarray(np.ascontiguousarray(queries.edited(made[i], e, i)), np.uint8))
    names = list(sets)
    rows = [(b"%d" % n, names[n][1] is not None, names[n][1] is None, image_copies.packed(at), bits.tobytes()) for n, (at, bits) in enumerate(sets.values())]
    found = image_copies.links(spark.createDataFrame(rows, "image binary, asks boolean, stored boolean, at binary, bits binary")).collect()
    got = {(names[int(r.query)], names[int(r.image)][0]) for r in found}
    want = {(q, i) for q in names if q[1] for i in ids if image_copies.matches(*sets[q], *sets[i, None]) >= image_copies.AGREEING}
    print("of all links", len(got & want) / len(want), "others", len(got - want))
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    for e in queries.EDITS:
        own = [q for q in names if q[1] == e]
        share = sum((q, q[0]) in got for q in own) / len(own)
        print(e, share)
        assert share >= 0.9
    same = {i: tuple(r.embedding) for i, r in zip(ids, vectors, strict=True)}
    near = lambda i, j: float(np.dot(same[i], same[j])) > 0.6
    assert all(near(q[0], i) for q, i in got)  # pictures of unlike vectors are no copies


def test_image_query(spark):
    got = QUERIES["op10_image_copies"](spark, SF.replace("0.001", "0.01")).collect()
    want = [r.vec_id for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").filter("vec_id % 20 = 0").collect()]
    assert sorted(r.vec_id for r in got) == sorted(want)
    assert sum(r.own_agreeing is not None for r in got) >= 0.9 * len(got) and all(r.n_copies >= (r.own_agreeing is not None) for r in got)


def test_descriptors_meet_in_tables():
    """The share of descriptors that are found at a distance is what the tables promise."""
    rng = np.random.default_rng(5)
    one = rng.integers(0, 256, (3000, 32), dtype=np.uint8)
    for d, least in ((0, 1.0), (8, 0.99), (16, 0.91), (24, 0.64)):
        bits = np.unpackbits(one, axis=1)
        for row in bits:
            row[rng.choice(256, d, replace=False)] ^= 1
        asked, stored = (image_copies.Corners([b"0"], [image_copies.packed(np.zeros((3000, 4)))], [x.tobytes()]) for x in (one, np.packbits(bits, axis=1)))
        a, b, apart = image_copies.Tables(asked).near(stored)
        assert (apart[a == b] == d).all() and np.mean(np.isin(np.arange(3000), a[a == b])) >= least


def test_pictures_hold_corners(spark):
    """The query's pictures have many more places than AGREEING matches need."""
    from urkunde.llm.queries import drawn

    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(100).collect()
    places = []
    for r in vectors:
        at, _ = image_copies.describe(drawn(r.embedding))
        places.append(len(np.unique(np.round((at[:, 0] + 1j * at[:, 1]) / image_copies.STRAY))))
    assert min(places) >= 4 * image_copies.AGREEING


def test_png():
    from urkunde.sources.export import png

    a = picture(1, 20, 30)
    assert (image_copies.read_image(png(20, 30, 1, a.tobytes())) == a).all()
    assert image_copies.read_image(image_copies.pgm(a)).shape == (20, 30)


def test_quality_stage_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).withColumns({c: F.lit("mine") for c in ("score", "predicted", "held_out")})
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert kept.columns == docs.columns and {(r.score, r.predicted, r.held_out) for r in kept.collect()} == {("mine",) * 3}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", None, "src0", 0), (-1, "", None, "src0", 0), (-2, "A plain sentence. " * 20000, "en", "src1", 7)], docs.schema)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    given, now, found = spark.read.parquet(str(tmp_path / "documents.parquet")), None, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = given if now is None else now
        stage(spark, before.limit(0), str(tmp_path)).collect()
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if i < 4:
            assert now.columns == docs.columns
        found.append(now.collect())
    quality, exact, near, mixed, encoded = found
    # 1: rows of the input, among them nearly all that are labelled good, and few of the others
    good = {r.doc_id: r.quality for r in labels.collect()}
    kept = collections.Counter(good.get(r.doc_id) for r in quality)
    assert {tuple(r) for r in quality} <= {tuple(r) for r in given.collect()}
    assert kept[1] >= 0.97 * sum(good.values()) and kept[0] <= 0.1 * (len(good) - sum(good.values()))
    # 2: of equal texts the largest id
    last = {}
    for r in quality:
        last[r.text or ""] = max(last.get(r.text or "", -9), -9 if r.doc_id is None else r.doc_id)
    assert sorted((r.text or "", -9 if r.doc_id is None else r.doc_id) for r in exact) == sorted(last.items())
    # 3: of linked texts the least id
    runs, parent = [shingled(r.text or "") for r in exact], list(range(len(exact)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(exact)):
        for j in range(i):
            if not set(runs[i]).isdisjoint(runs[j]) and is_near(runs[i], runs[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(exact):
        least[find(i)].append(-9 if r.doc_id is None else r.doc_id)
    assert sorted(-9 if r.doc_id is None else r.doc_id for r in near) == sorted(min(x) for x in least.values())
    # 4: each document as often as it is taken, to the nearest whole
    times = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 0 for r in mixture.plan(spark.createDataFrame(near, docs.schema)).collect()}
    assert collections.Counter(r.doc_id for r in mixed) == collections.Counter({k: v for k, v in times.items() if v})
    # 5: the library's ids
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(encoded) == len(mixed)
    for r in encoded:
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(encoded)
