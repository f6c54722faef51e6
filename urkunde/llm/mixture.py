"""A curriculum of sources mixed to target weights that change over the training run.

Each source's words stand in a fixed random order, repeated in passes. The integral of a source's weight
schedule says which share of its words is due by a moment of the run; inverted, it gives each document's
occurrence the moment at which it is due. Sorting by that range gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_SPACE, cut, remove, staged, text_of

#: Times that a source or a document may be taken.
PASSES = 3
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: For each weight: (moment of the run, times the mean weight); linear in between, mean 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Sums of parts, at most, that are broadcast; more are joined by a shuffle.
BROADCAST_PARTS = 100_000
#: Rows of a part, about. Documents of a source meet in parts by the first digits of their order: at least 16 ** DIGITS.
PART_ROWS, DIGITS = 4096, 2


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], folders: list[str]) -> DataFrame:
    """df with the sums over all rows before each in that order. Rows are dealt by ranges of the order; only the ranges'
    totals, one row a task, meet on the driver."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), folders, "ranges")
    totals = ranged.groupBy("_part").agg(*[F.sum(e).alias(n) for n, e in sums.items()]).orderBy("_part").collect()
    before, rows = [0.0] * len(sums), []
    for r in totals:
        rows.append((r["_part"], *before))
        before = [x + float(y) for x, y in zip(before, r[1:], strict=True)]
    names = [f"_{n}" for n in sums]
    carried = spark.createDataFrame(rows, "_part int, " + ", ".join(f"{n} double" for n in names))
    earlier = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = {n: F.coalesce(F.sum(e).over(earlier).cast("double"), F.lit(0.0)) for n, e in sums.items()}
    out = ranged.withColumns(within).join(F.broadcast(carried), "_part")
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *names)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight_at, target. sizes: source, source_size.

    All sizes are shared out by weight; a source that would get over PASSES times its own size gets that, and
    the excess is shared by weight among the others until none is above. In the order of that limit per
    weight the limited sources come first, so running sums give the level without iteration.
    """
    folders: list[str] = []
    by_name = F.col("source").asc_nulls_last()
    ranked = running(sizes, [by_name], {"place": F.lit(1)}, folders)
    ranked = ranked.withColumn("weight_at", (F.col("place") % len(WEIGHTS)).cast("int")).drop("place")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("weight_at") + 1).cast("double"))
    ranked = ranked.withColumn("most", (F.col("source_size") * PASSES).cast("double"))
    found = running(ranked, [F.col("most") / F.col("weight"), by_name], {"most_before": F.col("most"), "weight_before": F.col("weight")}, folders)
    all_size, all_weight = ranked.agg(F.sum(F.col("source_size").cast("double")), F.sum("weight")).first()
    level = (F.lit(all_size) - F.col("most_before")) / (F.lit(all_weight) - F.col("weight_before"))
    limited = F.col("most") / F.col("weight") <= F.col("level")
    found = staged(found.withColumn("level", level.cast("double")), folders, "levels")
    highest = found.filter(~limited).agg(F.max("level")).first()[0]
    target = F.when(limited, F.col("most")).otherwise(F.lit(highest).cast("double") * F.col("weight"))
    out = cut(found.select("source", "source_size", "weight_at", target.alias("target")))
    for folder in folders:
        remove(sizes.sparkSession, folder)
    return out


def moment(share: Column, weight_at: Column) -> Column:
    """The moment of the run at which that share of a source's words is due: the inverse of the schedule's integral."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(SCHEDULES):
        total = sum((a + b) / 2 * (t - s) for (s, a), (t, b) in zip(knots, knots[1:], strict=False))
        done, own = 0.0, F.lit(1.0)
        pieces = []
        for (s, a), (t, b) in zip(knots, knots[1:], strict=False):
            slope, rest = (b - a) / (t - s), share * total - F.lit(done)
            root = rest / a if slope == 0 else 2 * rest / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * rest)))
            done += (a + b) / 2 * (t - s)
            pieces.append((done / total, s + root))
        for end, at in reversed(pieces):
            own = F.when(share <= end, at).otherwise(own)
        out = F.when(weight_at == k, own).otherwise(out)
    return out


def plan(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """For each row: the kept columns, size (words), source_size, target, taken (words, repeats counted) and positions
    (the moments, from 0 to 1, at which its occurrences are due; empty if it is not taken).

    A source's taken words are its target, rounded: full passes and then the first words of one more, whose
    last document is taken in part. None is taken more than PASSES times. The order of a source's documents
    is that of the md5 of their ids (of a null id, of its text's md5); of equal ids, by size, the text's md5 and the
    kept columns, so that rows which tie in all of these are the same. Null ids and sources are values of their own;
    null and empty texts have size 0, are never taken and have no positions. An empty table gives an empty
    result. Kept columns named like a new one are replaced. Reruns agree.

    A source may be any share of the rows: its documents are dealt to parts by their order, the parts' sums
    are added up first, and each part only adds its own rows.
    """
    new = ("size", "source_size", "target", "taken", "positions")
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    content, types = F.md5(text_of(text).cast("binary")), dict(df.dtypes)
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(f"`{source}`").alias("source"),
        F.regexp_count(text_of(text), F.lit(NO_SPACE)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(f"`{id_column}`").cast("string"), content).cast("binary")).alias("order"),
        content.alias("tie"),
        F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in kept if "map<" not in types[c] and "variant" not in types[c]]).alias("last"),
    )
    # Sums for the finest parts that a digit of the order allows tell how many parts are needed.
    sums = cut(rows.groupBy("source", F.substring("order", 1, 4).alias("part")).agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    n = sums.agg(F.sum("n")).first()[0] or 0
    digits = DIGITS
    while digits < 4 and PART_ROWS * 16**digits < n:
        digits += 1
    by_source = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")))
    parts = sums.groupBy("source", F.substring("part", 1, digits).alias("part")).agg(F.sum("size").alias("size"))
    parts = parts.withColumn("before", F.sum("size").over(Window.partitionBy("source").orderBy("part")) - F.col("size")).drop("size")
    parts = cut(parts.join(by_source, parts["source"].eqNullSafe(by_source["source"])).select(parts["source"], "part", "before", "source_size", "weight_at", "target"))
    if parts.count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)
    rows = rows.withColumn("part", F.substring("order", 1, digits))
    within = Window.partitionBy("source", "part").orderBy("order", "size", "tie", "last").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.alias("r").join(parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part")))
    due = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(due / F.col("source_size"))).otherwise(0).cast("long")
    start = F.col("before") + F.col("within")
    partly = F.greatest(F.lit(0), F.least(F.col("size"), due - passes * F.col("source_size") - start))
    shares = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(PASSES)), lambda i: (i < passes) | ((i == passes) & (partly > 0))),
        lambda i: moment((i * F.col("source_size") + start) / F.col("target"), F.col("weight_at")),
    )
    return rows.select(
        "row.*",
        "size",
        "source_size",
        "target",
        (passes * F.col("size") + partly).cast("long").alias("taken"),
        F.when(F.col("size") > 0, shares).otherwise(F.array().cast("array<double>")).alias("positions"),
        F.struct("order", "size", "tie", "last").alias("_order"),
    )


def by_position(planned: DataFrame) -> DataFrame:
    """Rows in the order of their first occurrence, those that are not taken last."""
    return planned.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "_order").drop("_order")


def mix(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of df in training order, each as often as it is taken; one that is taken in part stays whole if at
    least half of its words are due."""
    columns = [f"`{c}`" for c in df.columns]
    packed = df.select(F.struct(*columns).alias("_all"), F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text}`").alias("_text"), F.col(f"`{source}`").alias("_source"))
    planned = plan(packed, "_id", "_text", "_source", keep=["_all"])
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    return (
        planned.filter("size > 0 and taken > 0")
        .select("_all", "_order", F.explode(F.slice("positions", F.lit(1), times)).alias("_at"))
        .orderBy("_at", "_order")
        .select("_all.*")
    )
