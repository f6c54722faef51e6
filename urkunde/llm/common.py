"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, and bytes, in an Arrow batch. Texts can be long, and a batch is held whole on both sides of the pipe.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Characters of a word separator.
NO_SPACE = r"[^\x20\x09-\x0D]+"


def not_local(master: str) -> bool:
    return master != "local" and not master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only where the session names none and is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and context._jsc.sc().getCheckpointDir().isEmpty() and not_local(context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="urkunde-"))
    return context._jsc.sc().getCheckpointDir().get()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's name inside the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, folders: list[str], name: str) -> DataFrame:
    """The rows of df written to a new folder and read again; the folder is added to those to be removed."""
    folders.append(work_dir(df.sparkSession, name))
    df.write.parquet(folders[-1])
    return df.sparkSession.read.schema(df.schema).parquet(folders[-1])


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files behind plans that cut() has made needless; it does so on garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Has the executors collect their garbage, so that the heap that a former stage has made them take goes back to the
    system before the next one's Python workers need it."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").agg(F.max("done")).collect()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that no plan reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(F.col(f"`{column}`").cast("string").cast("binary")), F.lit(modulus))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: What modules keep in a worker from task to task, by module.
CACHES: dict[str, dict] = {}


def own_cache(module: str) -> dict:
    """A module's cache in this worker. It is emptied when a task of another module runs there, so that an operator has not
    got the memory of those before it as well."""
    return CACHES.setdefault(module, {})


def give_back(module: str) -> None:
    """Empties the caches of other modules; what Arrow and the C library have set aside goes back to the system."""
    held = [c for m, c in CACHES.items() if m != module and c]
    for cache in held:
        cache.clear()
    if held:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits on Arrow batches to BATCH_ROWS and BATCH_BYTES; they act when a plan runs, so they stay.

    Smaller limits of the caller's are left as they are.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, None) or "0")
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 64) -> Iterator[None]:
    """Arrow batches of few rows for the plans that run meanwhile: rows that a join has given whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def map_batches(
    df: DataFrame,
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds columns batch by batch in Python.

    make() runs once a task and gives a function from a batch to the new columns. keep names the columns
    that go on; a kept column of a new column's name gives way to it. Rows stay where they are.
    """
    bound_batches(df.sparkSession)
    new = {n for n, _ in fields}
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name not in new]
    schema = T.StructType([*kept, *(T.StructField(n, t, True) for n, t in fields)])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(make.__module__)
        function = make()
        for batch in batches:
            if batch.num_rows:
                made = [
                    x.cast(arrow.field(len(names) + i).type) if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(len(names) + i).type)
                    for i, x in enumerate(function(batch))
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], schema=arrow)

    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The column's values one at a time, null as empty."""
    for x in batch.column(column):
        yield x.as_py() or ""


#: A group with more than this share of all rows is hot; there are fewer than its inverse, so these may be broadcast.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined to the groups that they make up. groups: one row for each key, with its number of rows in n.

    Hot groups are joined by broadcast, so that no task gets all rows of one; the others by a shuffle.
    """
    groups = cut(groups)
    total = groups.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) > max(1, int(total * HOT_SHARE))
    hot = F.broadcast(groups.filter(is_hot))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(groups.filter(~is_hot), key))


#: Bits of the filter that says which rows may have one of many keys; it is sent to all tasks whatever the number of keys.
FILTER_BITS = 1 << 23


def may_have(rows: DataFrame, key: Column, keys: Column, of: DataFrame) -> DataFrame:
    """rows with a column `may`: false only where no row of `of` has this key.

    The keys set bits of a table of FILTER_BITS, which is at most 2 MB, so that rows without such a key are told
    where they are and only the others need a shuffle. With very many keys all bits are set: more rows are shuffled.
    """
    place = F.pmod(F.xxhash64(keys), F.lit(FILTER_BITS)).alias("_place")
    words = of.select(place).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_place & 63 as int)))").alias("_bits"))
    marked = rows.withColumn("_place", F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))).withColumn("_word", F.shiftright("_place", 6))
    joined = marked.join(F.broadcast(words), "_word", "left")
    may = F.expr("coalesce(shiftrightunsigned(_bits, cast(_place & 63 as int)) & 1L, 0L) = 1L")
    return joined.withColumn("may", may).drop("_word", "_place", "_bits")


def keep_rows(df: DataFrame, decided: DataFrame, id_column: str, node: Column) -> DataFrame:
    """The rows of df that are kept, with df's columns.

    decided: id, node, kept for all rows of the groups that lose any. Rows with the same id and node are told
    apart by nothing: of them one is kept if one is. Rows of other nodes are not moved.
    """
    keys = cut(decided.groupBy("id", "node").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all"), F.col(f"`{id_column}`").alias("own_id"), node.alias("own_node"))
    rows = may_have(rows, F.concat_ws(" ", F.hex("own_node"), F.col("own_id").cast("string")), F.concat_ws(" ", F.hex("node"), F.col("id").cast("string")), keys)
    moved = rows.filter("may").drop("may")

    def same(k: DataFrame) -> Column:
        return (moved["own_node"] == k["node"]) & moved["own_id"].eqNullSafe(k["id"])

    repeated = keys.filter("kept")
    out = rows.filter("not may").drop("may").unionByName(moved.join(keys, same(keys), "left_anti"))
    if not repeated.isEmpty():
        out = out.unionByName(moved.join(repeated, same(repeated), "left_semi").dropDuplicates(["own_id", "own_node"]))
    return out.select("all.*")
