import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from urkunde import config
from urkunde.operators import ocr, process
from urkunde.sources import export

GOOD = "Verordnung über die Berufsausbildung zum Koch\nBundesministerium für Arbeit\nStand vom 1. März 1938\n" + "der die das und " * 10


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    for name in ("good.png", "blank.png"):
        (tmp_path / name).write_bytes(export.png(20, 30, 3, rng.integers(0, 256, (20, 30, 3), dtype=np.uint8).tobytes()))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    (tmp_path / "scan.PDF").write_bytes(b"%PDF three pages")
    (tmp_path / "broken.pdf").write_bytes(b"%PDF broken")
    (tmp_path / "notes.txt").write_bytes(b"unknown kind")
    return tmp_path


def rasteriser():
    def rasterise(content, dpi):
        import numpy

        if b"broken" in content:
            raise ValueError("no PDF at all")

        def page(i):
            if i == 2:
                raise ValueError("page 2 is torn")
            return numpy.full((10, 10, 3), 200, numpy.uint8)

        return 3, page

    return rasterise


def test_process(spark, folder):
    """Good, blank, broken and missing files, and a PDF of which one page fails: a record for each, in the order asked for."""
    texts = {"good.png#1": GOOD, "scan.PDF#1": "Satzung der Kammer, " * 3, "scan.PDF#3": "vom 2.3.1940 " * 3}
    asked = ["good.png", "none.png", "bad.png", "scan.PDF", "broken.pdf", "blank.png"]
    wanted = spark.createDataFrame([(f"file:{folder}/{n}", i) for i, n in enumerate(asked)], "path string, ordinal int")
    settings = config.ProcessingConfig().but(enable_interactive_mode=False, preferred_approaches=("direct", "nope"))
    out = process.process(spark, str(folder), ocr.SidecarBackend(json.dumps(texts)), settings, wanted, rasterise=rasteriser()).cache()
    got = {r.ordinal: r for r in out.collect()}
    assert sorted(got) == list(range(6))
    assert got[0].error is None and (got[0].title, str(got[0].date), got[0].successful_approach) == ("Verordnung über die Berufsausbildung zum Koch", "1938-03-01", "direct")
    assert got[0].ocr_attempts_count == 2 and got[0].analysis_quality and got[0].analysis_document_type == "official_document" or got[0].analysis_document_type
    assert got[0].processing_time_seconds > 0 and float(got[0].processing_metadata["processing_time_seconds"]) > 0
    assert got[0].success is None and got[1].success is False and got[0].status == "success" and got[1].status == "failed"
    assert got[1].error == f"File not found: file:{folder}/none.png" and got[1].processing_metadata["success"] == "false"
    assert got[2].error.startswith("Cannot load image") and got[4].error == "PDF processing failed: no PDF at all"
    assert got[5].error == "No text could be extracted from document" and got[5].successful_approach == "direct"
    assert got[3].error is None and got[3].document_type == "Satzung" and str(got[3].date) == "1940-03-02"
    results = json.loads(got[3].processing_metadata["page_results"])
    assert [(r["page_num"], r["success"], r.get("error")) for r in results] == [(1, True, None), (2, False, "page 2 is torn"), (3, True, None)]
    assert got[3].text.startswith("\n--- Page 1 ---\n") and got[3].processing_metadata["successful_pages"] == "2"
    assert list(json.loads(export.as_json(out.filter("ordinal = 0")).first().value)) == list(export.KEYS)
    export.write_json(out, str(folder / "json"), ordered=True)
    lines = [json.loads(x) for p in sorted((folder / "json").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["processing_metadata"]["file_path"].rsplit("/", 1)[-1] for x in lines] == asked


def test_all_files_of_a_folder(spark, folder):
    out = process.process(spark, str(folder), ocr.NullBackend(), config.for_archive(), first=2, last=2, rasterise=rasteriser())
    assert sorted(r.doc_id.rsplit("/", 1)[-1] for r in out.collect()) == ["bad.png", "blank.png", "broken.pdf", "good.png", "scan.PDF"]


def test_typed_choices(spark, folder):
    """In interactive mode what was typed chooses among the first five; an explicit approach is not asked for."""
    pages = process.files.images(spark, str(folder)).filter("doc_id like '%good%'")
    typed = pages.select("doc_id", "page_num", F.lit("2").alias("typed"))
    settings = config.ProcessingConfig()
    backend = ocr.SidecarBackend(json.dumps({"good.png#1": "kurz"}))
    row = process.read_pages(pages, backend, settings, typed=typed).first()
    assert [a.approach for a in row.attempts] == [row.recommended[1]] and row.user_choice == row.recommended[1]
    assert [a.approach for a in process.read_pages(pages, backend, settings, choice="newspaper", typed=typed).first().attempts] == ["newspaper"]
    quiet = settings.but(enable_interactive_mode=False)
    assert len(process.read_pages(pages, backend, quiet, typed=typed).first().attempts) > 1


def test_timeout(spark, folder):
    class Stuck:
        def read(self, image, language, key, config=""):
            if config != "--psm 6":
                time.sleep(30)
            return ""

    settings = config.ProcessingConfig().but(processing_timeout_seconds=1, preferred_approaches=("direct",), enable_interactive_mode=False)
    out = process.process(spark, str(folder), Stuck(), settings, rasterise=rasteriser()).filter("doc_id like '%good%'").first()
    assert out.error == "Processing took more than 1 seconds" and out.ocr_attempts_count == 0
    pages = process.files.images(spark, str(folder)).filter("doc_id like '%good%'").withColumns({"approaches": F.array(F.lit("direct")), "image_quality": F.lit("good")})
    late = ocr.attempts(pages, Stuck(), settings).collect()
    assert [(r.success, r.error) for r in late] == [(False, "Processing took more than 1 seconds")]


def test_saved_images(spark, folder):
    pages = process.files.images(spark, str(folder))
    from urkunde.operators import images

    last = images.processed(pages, "light")
    got = {r.doc_id.rsplit("/", 1)[-1]: r for r in export.save_images(last, f"file://{folder}/out").collect()}
    assert set(got) == {"good.png", "blank.png"} and all(r.error is None for r in got.values())
    assert (folder / "out" / "processed_light_good.png").read_bytes()[:8] == b"\x89PNG\r\n\x1a\n"
    assert all(r.error for r in export.save_images(last, "file:///proc/no/such").collect())


def test_logs(tmp_path):
    import logging

    from urkunde import logs

    logger = logs.setup(logs.LoggingConfig(level="info", file_path=str(tmp_path / "processing.log")))
    logger.info("hello")
    logging.getLogger("urkunde").debug("not shown")
    assert "hello" in (tmp_path / "processing.log").read_text() and "not shown" not in (tmp_path / "processing.log").read_text()
    assert len(logs.setup(logs.LoggingConfig()).handlers) == 1
