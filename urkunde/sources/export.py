"""Results as JSON and images as files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the keys of an exported record in their order.
KEYS = (
    "title", "year", "date", "publisher", "author", "document_type", "profession", "confidence_scores", "overall_confidence",
    "raw_text_preview", "processing_metadata", "ocr_attempts_count", "successful_approach", "analysis_document_type", "analysis_quality",
)


def records(metadata: DataFrame) -> DataFrame:
    """The exported record's columns; those that metadata lacks are null, the count of attempts 0."""
    given = {c: F.col(c) for c in metadata.columns} | {"date": F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")}
    missing = {"ocr_attempts_count": F.lit(0), "processing_metadata": F.create_map().cast("map<string,string>")}
    return metadata.select(*[given.get(k, missing.get(k, F.lit(None).cast("string"))).alias(k) for k in KEYS])


def as_json(metadata: DataFrame, pretty: bool = False) -> DataFrame:
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})
    return records(metadata).select(F.to_json(F.struct(*KEYS), options).alias("value"))


def write_json(metadata: DataFrame, folder: str, ordered: bool = False) -> None:
    """One record a line; ordered: in the order of `ordinal`, the place at which a document was asked for."""
    out = metadata.orderBy("ordinal") if ordered else metadata
    records(out).write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG file of grey or blue-green-red bytes."""
    import numpy

    a = numpy.frombuffer(data, numpy.uint8).reshape(height, width, channels)[..., ::-1]
    lines = numpy.concatenate([numpy.zeros((height, 1), numpy.uint8), a.reshape(height, -1)], 1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_steps(images: DataFrame, folder: str) -> None:
    """Images after chains (operators.images.processed) as Parquet by approach and step, with the PNG files as a column."""

    @F.pandas_udf("binary")
    def encode(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([png(*x) for x in zip(height, width, channels, data, strict=True)], dtype=object)

    out = images.withColumn("png", encode("height", "width", "channels", "data")).drop("data")
    out.write.mode("overwrite").partitionBy("approach", "step").parquet(folder)


def save_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes each image after a chain (operators.images.processed) as processed_{approach}_{name}.png; gives doc_id,
    page_num, path, error. The folder is a URI that all executors see; a file that cannot be written is an error row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                name = r.doc_id.rsplit("/", 1)[-1].rsplit(".", 1)[0] + (f"_{r.page_num}" if r.page_num > 1 else "")
                path, error = f"{folder}/processed_{r.approach}_{name}.png", None
                try:
                    system, own = fs.FileSystem.from_uri(path)
                    system.create_dir(own.rsplit("/", 1)[0])
                    with system.open_output_stream(own) as out:
                        out.write(png(r.height, r.width, r.channels, r.data))
                except (OSError, ValueError) as e:
                    error = f"Failed to save image: {e}"
                rows.append((r.doc_id, r.page_num, path, error))
            yield pd.DataFrame(rows, columns=["doc_id", "page_num", "path", "error"])

    return images.mapInPandas(run, "doc_id string, page_num int, path string, error string")
