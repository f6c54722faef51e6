"""Files as sources: listing, dispatch, images, PDF pages, content hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Fixed value: the extensions that are known.
EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp")


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty without one. A name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def branch(path: Column) -> Column:
    """Which way a file is read: anything that is not a PDF is taken for an image."""
    return F.when(extension(path) == ".pdf", "pdf").otherwise("image")


def glob_of(extensions: tuple[str, ...]) -> str:
    """A file glob for the extensions in either case, so that other files are neither opened nor listed as rows."""
    either = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return "*{" + ",".join(either) + "}"


def files(spark: SparkSession, folder: str, content: bool = False, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, ext, length, mtime, md5 and, if asked for, content of the files with these extensions."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob_of(extensions)).load(folder)
    out = found.select("path", extension(F.col("path")).alias("ext"), "length", F.col("modificationTime").alias("mtime"), F.md5("content").alias("md5"), *["content"] * content)
    return out.filter(extension(F.col("path")).isin(*extensions))  # a name that only starts with a dot has no extension


def requested(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """wanted (path, ordinal) with what is known of each file; error where there is none."""
    out = wanted.join(present, "path", "left")
    return out.withColumn("error", F.when(F.col("length").isNull(), F.concat(F.lit("File not found: "), F.col("path"))))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, page_num, image, error of image files; those that cannot be decoded have a height of -1."""
    found = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", glob_of(EXTENSIONS[1:])).load(folder)
    name = F.regexp_replace("image.origin", "^file:/+", "file:/")  # as the other sources write it
    error = F.when(F.col("image.height") < 0, F.concat(F.lit("Cannot load image: "), name))
    return found.select(name.alias("doc_id"), F.lit(1).alias("page_num"), "image", error.alias("error"))


#: From a PDF's bytes and dpi to the number of its pages and a function from a page's number to its pixels (h x w x 3,
#: blue, green, red).
Rasteriser = Callable[[bytes, int], tuple[int, Callable[[int], Any]]]


def by_pdf2image(content: bytes, dpi: int) -> tuple[int, Callable]:
    """Needs pdf2image and its programs. Pages are made one at a time."""
    import numpy
    from pdf2image import convert_from_bytes, pdfinfo_from_bytes

    def page(number: int):
        (one,) = convert_from_bytes(content, dpi=dpi, first_page=number, last_page=number)
        return numpy.asarray(one.convert("RGB"))[..., ::-1]

    return int(pdfinfo_from_bytes(content)["Pages"]), page


def pdf_pages(found: DataFrame, first: int = 1, last: int | None = None, dpi: int = 300, rasterise: Rasteriser = by_pdf2image) -> DataFrame:
    """doc_id, page_num, image, error of PDF files' pages from first to last (null: all). found: path, content.

    Pages go on one by one. A file that cannot be read, or has no such page, gives one row with an error and no image;
    a page that fails gives its own.
    """

    class Pages:
        def eval(self, content: bytes) -> Iterator[tuple]:
            try:
                n, page = rasterise(bytes(content), dpi)
                numbers = range(first, min(n, last or n) + 1)
                if not numbers:
                    raise ValueError("No pages could be converted from PDF")
            except Exception as e:  # noqa: BLE001  a broken file is an error row, not the job's end
                yield None, None, f"PDF processing failed: {e}"
                return
            for i in numbers:
                try:
                    a = page(i)
                    yield i, ("", a.shape[0], a.shape[1], 3, 16, a.tobytes()), None
                except Exception as e:  # noqa: BLE001
                    yield i, None, str(e)

    pages = udtf(Pages, returnType="page_num int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, error string")
    return found.lateralJoin(pages(F.col("content").outer())).select(F.col("path").alias("doc_id"), "page_num", "image", "error")
