import json
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from urkunde import config
from urkunde.functions import recommend, scoring
from urkunde.operators import assemble, attempts, images, ocr, pixels
from urkunde.sources import export, files
from urkunde.streaming import inbox


def test_config():
    c = config.ProcessingConfig(confidence_threshold=7)
    assert c.confidence_threshold == 1.0 and c.save_intermediate_images and c.enable_interactive_mode
    assert config.for_research().max_approaches_to_try == 8
    archive = config.for_archive()
    assert (archive.max_approaches_to_try, archive.early_exit_confidence, archive.max_workers, archive.processing_timeout_seconds) == (3, 0.7, 8, 120)
    era = config.for_era("1933-1945")
    assert (era.ocr_language, era.confidence_threshold, era.max_approaches_to_try, era.output_directory) == ("deu_frak", 0.6, 8, "output_1933_1945")
    assert era.approaches_for("2100") == config.OTHER_ERA and len(era.summary()) == 8
    assert config.ProcessingConfig(processing_mode="production").early_exit_confidence == 0.75
    with pytest.raises(config.ConfigurationError):
        config.for_era("1800")
    assert config.example().max_approaches_to_try == 5


def test_confidence_against_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for quality in (None, "poor", "excellent"):
        q = F.lit(quality) if quality else None
        for r in docs.select("text", scoring.ocr_confidence(F.col("text"), q).alias("c")).collect():
            assert r.c == pytest.approx(ocr.confidence(r.text, quality), abs=1e-12)


def test_choices(spark):
    typed = ["", "0", "a", "s", "1", "3", "9", "x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(typed)], "i int, t string")
    shown = recommend.names(["standard", "light", "direct"])
    got = [tuple(r.c) for r in df.select("i", recommend.parsed_choice(F.col("t"), shown).alias("c")).orderBy("i").collect()]
    assert got == [(None, True), (None, True), ("all_recommended", True), ("skip_analysis", True), ("standard", True), ("direct", True), (None, False), (None, False), (None, True)]


def picture(h, w, seed):
    return np.random.default_rng(seed).integers(0, 256, (h, w), dtype=np.uint8)


def relation(spark, a):
    return spark.createDataFrame([(0, y, x, int(v)) for (y, x), v in np.ndenumerate(a)], "page_id int, y int, x int, v int")


def array(df):
    rows = df.collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), int)
    for r in rows:
        out[r.y, r.x] = r.v
    return out


def test_pixels_against_numpy(spark):
    a = picture(12, 17, 1)
    df = relation(spark, a)
    assert (array(pixels.invert(df)) == images.invert(a)).all()
    assert (array(pixels.contrast(df)) == images.contrast(a)).all()
    assert (array(pixels.binarize(df)) == images.binarize(a)).all()
    assert (array(pixels.border(df, 3)) == images.border(a, 3)).all()
    middle = array(pixels.center(df).withColumns({"y": F.col("y") - 3, "x": F.col("x") - 4}))
    assert (middle == images.center(a)).all()
    assert pixels.otsu(df).first().threshold == images.otsu_threshold(a)
    assert pixels.noise(df).first().noise_level == pytest.approx(images.noise_level(a))


def test_steps():
    a = picture(20, 30, 2)
    assert images.scale(a, 2.5).shape == (50, 75)
    flat = np.full((9, 9), 77, np.uint8)
    assert (images.scale(flat, 2.0) == 77).all() and (images.denoise(flat) == 77).all()
    noisy = np.clip(128 + np.random.default_rng(0).normal(0, 8, (24, 24)), 0, 255).astype(np.uint8)
    assert images.denoise(noisy).std() < noisy.std()
    for name in images.PIPELINES:
        assert images.run_pipeline(np.repeat(a[..., None], 3, 2), name).size
    with pytest.raises(ValueError, match="Unknown approach"):
        images.run_pipeline(a, "nope")
    assert images.step_name(("contrast", 1.2, 10)) == "contrast(1.2, 10)"


def flood(free, start, around):
    out, edge = {start}, [start]
    while edge:
        y, x = edge.pop()
        for dy, dx in around:
            p = (y + dy, x + dx)
            if 0 <= p[0] < free.shape[0] and 0 <= p[1] < free.shape[1] and free[p] and p not in out:
                out.add(p)
                edge.append(p)
    return out


def traced(binary):
    """Areas within, and heights of, the outer outlines, by following each border pixel by pixel."""
    on = np.pad(binary > 0, 1)
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    outside, seen, out = flood(~on, (0, 0), around[::2]), set(), []
    for first in map(tuple, np.argwhere(on)):
        if first in seen:
            continue
        seen |= flood(on, first, around)
        if (first[0], first[1] - 1) not in outside:
            continue
        points, at, back, second = [first], first, 4, None
        while True:
            steps = [(at[0] + around[(back + k) % 8][0], at[1] + around[(back + k) % 8][1], (back + k) % 8) for k in range(1, 9)]
            steps = [s for s in steps if on[s[:2]]]
            if not steps or (at == first and second == steps[0][:2]):
                break
            second = second or steps[0][:2]
            at, back = steps[0][:2], (steps[0][2] + 4) % 8
            points.append(at)
        y, x = np.array(points, float).T
        out.append((abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2, int(y.max() - y.min()) + 1))
    return sorted(out)


def test_shapes_against_tracing():
    a = np.zeros((40, 60), np.uint8)
    a[5:15, 5:25] = 255
    a[20:35, 30:50] = 255
    a[25:30, 35:45] = 0
    a[27, 38:40] = 255  # enclosed: not counted
    areas, heights = images.shapes(a)
    assert sorted(areas) == [9 * 19, 14 * 19] and images.text_shape(a)[1] == "small" and 0 < images.text_shape(a)[0] < 1
    rng = np.random.default_rng(5)
    for share in (0.1, 0.3, 0.5, 0.7, 0.9):
        for _ in range(6):
            a = (rng.random((25, 31)) < share).astype(np.uint8)
            areas, heights = images.shapes(a)
            assert sorted(zip(areas, heights, strict=True)) == traced(a)
    for a in (np.zeros((3, 4), np.uint8), np.ones((3, 4), np.uint8)):
        assert sorted(zip(*images.shapes(a), strict=True)) == traced(a)
    big = np.kron(rng.integers(0, 2, (300, 400)), np.ones((5, 5))).astype(np.uint8)
    began = time.process_time()
    images.shapes(big)
    assert time.process_time() - began < 10


def test_denoise_in_strips(monkeypatch):
    a = picture(40, 30, 7)
    whole = images.denoise(a)
    monkeypatch.setattr(images, "STRIP", 200)
    assert (images.denoise(a) == whole).all()


def write_png(path, a):
    channels = 1 if a.ndim == 2 else 3
    path.write_bytes(export.png(*a.shape[:2], channels, np.ascontiguousarray(a).tobytes()))


@pytest.fixture
def folder(tmp_path):
    write_png(tmp_path / "one.png", np.repeat(picture(40, 50, 3)[..., None], 3, 2))
    write_png(tmp_path / "two.png", picture(16, 16, 4))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    return tmp_path


def test_images_and_ocr(spark, folder):
    found = files.images(spark, str(folder))
    assert found.filter("error is not null").count() == 1
    good = "Verordnung der Minister und die Ordnung, vom 1. Mai 1938 (Stand vom 2.3.1940). " * 8
    backend = ocr.SidecarBackend(json.dumps({"one.png#1": good, "two.png#1#deu": "kurz", "two.png#1#deu_frak": "ein längerer Text in Fraktur"}))
    measured = images.analysis(images.metrics(found).join(ocr.samples(found, backend), ["doc_id", "page_num"]), "sample")
    rows = {r.doc_id.rsplit("/", 1)[-1]: r for r in measured.collect()}
    assert rows["bad.png"].error.startswith("Cannot load image") and (rows["one.png"].width, rows["one.png"].height) == (50, 40)
    settings = config.ProcessingConfig().but(early_exit_confidence=0.6)
    pages = found.select("doc_id", "page_num", "image").join(measured.select("doc_id", "image_quality"), "doc_id").withColumn("approaches", recommend.names(["direct", "nope", "standard"]))
    tried = ocr.attempts(pages, backend, settings).cache()
    by = {}
    for r in tried.collect():
        by.setdefault(r.doc_id.rsplit("/", 1)[-1], []).append(r)
    assert [r.approach for r in by["one.png"]] == ["direct"]
    assert [(r.success, r.error) for r in by["two.png"]] == [(True, None), (False, "Unknown approach: nope"), (True, None)]
    assert by["two.png"][0].text == "ein längerer Text in Fraktur" and all(r.processing_time > 0 for r in by["two.png"])
    assert not any(r.success for r in by["bad.png"])
    out = {r.doc_id.rsplit("/", 1)[-1]: r for r in attempts.outcome(tried, ["doc_id", "page_num"]).collect()}
    assert out["one.png"].text == good and out["bad.png"].text == "" and out["bad.png"].successful_approach is None
    relation_form = attempts.tried(tried, ["doc_id", "page_num"], settings.early_exit_confidence, settings.early_exit_min_length)
    assert relation_form.count() == tried.count()
    steps = images.processed(found.filter("error is null"), "light", steps=True)
    assert steps.count() == 6
    export.write_steps(steps, str(folder / "steps"))
    assert spark.read.parquet(str(folder / "steps")).filter("png is not null").count() == 6


def test_files(spark, folder):
    (folder / "x.txt").write_text("no")
    (folder / "y.PDF").write_bytes(b"%PDF-broken")
    names = {r.path.rsplit("/", 1)[-1]: r for r in files.files(spark, str(folder), content=True).collect()}
    assert set(names) == {"one.png", "two.png", "bad.png", "y.PDF"} and names["y.PDF"].ext == ".pdf"
    wanted = spark.createDataFrame([(names["one.png"].path, 1), ("file:/none.png", 2)], "path string, ordinal int")
    got = files.requested(wanted, files.files(spark, str(folder))).orderBy("ordinal").collect()
    assert got[0].error is None and got[1].error == "File not found: file:/none.png"
    pdf = files.pdf_pages(files.files(spark, str(folder), content=True).filter("ext = '.pdf'")).collect()
    assert len(pdf) == 1 and pdf[0].error.startswith("PDF processing failed")
    cached = files.files(spark, str(folder)).select("path", "md5")
    done = cached.filter("path like '%one.png'").select("md5", F.lit("x").alias("result"))
    assert assemble.not_yet_processed(cached, done).count() == 3 and assemble.cached_results(cached, done).count() == 1
    paths = spark.createDataFrame([("test.pdf",), ("test.jpg",), ("test.txt",), (".png",), ("a.b/c",)], "p string")
    assert [r[0] for r in paths.select(files.is_supported(F.col("p"))).collect()] == [True, True, False, False, False]


def test_assembly_and_truth(spark):
    pages = spark.createDataFrame([(1, 2, "zwei", None), (1, 1, "eins", None), (1, 3, " \n", None), (2, 1, None, "broken")], "doc_id int, page_num int, text string, error string")
    got = {r.doc_id: r for r in assemble.documents(pages).collect()}
    assert got[1].text == "\n--- Page 1 ---\neins\n\n--- Page 2 ---\nzwei" and got[1].successful_pages == 2
    assert got[2].error == "No text could be extracted from document" and got[2].page_results[0].error == "broken"
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, title string")
    records = spark.createDataFrame([(1, "a"), (2, "c")], "doc_id int, title string")
    assert assemble.ground_truth(records, truth, ["title"]).first().title == 0.5


def test_json_and_inbox(spark, tmp_path):
    data = [(1, "Verordnung\nBundesministerium für Arbeit\nStand vom 1. März 1938"), (2, "leer")]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    query = inbox.drain(inbox.extracted(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    record = json.loads(export.as_json(found.filter("doc_id = 1")).first().value)
    assert list(record) == list(export.KEYS) and record["date"] == "1938-03-01T00:00:00" and record["profession"] is None and record["ocr_attempts_count"] == 0
    export.write_json(found, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_early_exit_against_loop(spark):
    rng = random.Random(3)
    rows = [(p, k, rng.choice([0.1, 0.8, 0.85, 0.9]), rng.choice([50, 100, 101, 300])) for p in range(200) for k in range(1, rng.randint(2, 7))]
    df = spark.createDataFrame(rows, "page int, rk int, confidence double, text_length int")
    got = {(r.page, r.rk) for r in attempts.tried(df, ["page"]).collect()}
    want, over = set(), set()
    for p, k, c, n in sorted(rows):
        if p not in over:
            want.add((p, k))
            if c > 0.8 and n > 100:
                over.add(p)
    assert got == want


def test_png_round_trip():
    a = picture(5, 7, 9)
    raw = export.png(5, 7, 1, a.tobytes())
    at = raw.index(b"IDAT") + 4
    lines = np.frombuffer(zlib.decompress(raw[at : raw.index(b"IEND") - 8]), np.uint8).reshape(5, 8)
    assert (lines[:, 1:] == a).all()


def test_denoise_by_definition():
    """Each pixel as the mean of its surroundings weighed by patches, one pixel after the other."""
    a, patch, reach, strength = picture(9, 11, 12), 1, 2, 30.0
    wide = np.pad(a.astype(float), patch + reach, mode="reflect")
    want = np.zeros(a.shape)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            cy, cx, total, weights = y + patch + reach, x + patch + reach, 0.0, 0.0
            own = wide[cy - patch : cy + patch + 1, cx - patch : cx + patch + 1]
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    other = wide[cy + dy - patch : cy + dy + patch + 1, cx + dx - patch : cx + dx + patch + 1]
                    weight = np.exp(-((own - other) ** 2).mean() / strength**2)
                    total += weight * wide[cy + dy, cx + dx]
                    weights += weight
            want[y, x] = total / weights
    assert (np.abs(images.denoise(a, strength, patch, reach) - want) <= 0.5 + 1e-6).all()
