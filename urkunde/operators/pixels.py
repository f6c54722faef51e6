"""Image metrics and point-wise steps on pixel relations: an image's key, y, x, v."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "page_id"


def invert(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", 255 - F.col("v"))


def contrast(pixels: DataFrame, alpha: float = 1.2, beta: float = 10.0) -> DataFrame:
    """|alpha v + beta|, rounded half to even, at most 255."""
    return pixels.withColumn("v", F.least(F.lit(255), F.bround(F.abs(F.col("v") * alpha + beta)).cast("int")))


def binarize(pixels: DataFrame, threshold: int = 127) -> DataFrame:
    return pixels.withColumn("v", F.when(F.col("v") > threshold, 255).otherwise(0))


def size(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(KEY).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def center(pixels: DataFrame) -> DataFrame:
    """The middle half of both sides."""
    inside = F.expr("y >= h div 4 AND y < 3 * h div 4 AND x >= w div 4 AND x < 3 * w div 4")
    return pixels.join(size(pixels), KEY).filter(inside).drop("h", "w")


def border(pixels: DataFrame, width: int = 50, value: int = 255) -> DataFrame:
    """The image with a frame: the old pixels moved, and generated ones around them."""
    frame = size(pixels).select(
        KEY,
        "h",
        "w",
        F.explode(F.sequence(F.lit(0), F.col("h") + 2 * width - 1)).alias("y"),
    ).select(KEY, "h", "w", "y", F.explode(F.sequence(F.lit(0), F.col("w") + 2 * width - 1)).alias("x"))
    outside = (F.col("y") < width) | (F.col("y") >= F.col("h") + width) | (F.col("x") < width) | (F.col("x") >= F.col("w") + width)
    moved = pixels.select(KEY, (F.col("y") + width).cast("int").alias("y"), (F.col("x") + width).cast("int").alias("x"), "v")
    return moved.unionByName(frame.filter(outside).select(KEY, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(value).alias("v")))


def brightness_contrast(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(KEY).agg(F.avg("v").alias("brightness"), F.stddev_pop("v").alias("contrast"))


def noise(pixels: DataFrame) -> DataFrame:
    """Variance of the four-neighbour Laplacian over 1000, at most 1; at borders the inner neighbour counts twice."""
    row, column = Window.partitionBy(KEY, "y").orderBy("x"), Window.partitionBy(KEY, "x").orderBy("y")
    side = lambda w: F.coalesce(F.lag("v").over(w), F.lead("v").over(w)) + F.coalesce(F.lead("v").over(w), F.lag("v").over(w))
    return pixels.select(KEY, (side(row) + side(column) - 4 * F.col("v")).alias("l")).groupBy(KEY).agg(F.least(F.var_pop("l") / 1000, F.lit(1.0)).alias("noise_level"))


def otsu(pixels: DataFrame) -> DataFrame:
    """The threshold of the largest between-class variance, the least of equals."""
    histogram = pixels.groupBy(KEY, "v").agg(F.count("*").cast("double").alias("n"))
    upto, every = Window.partitionBy(KEY).orderBy("v"), Window.partitionBy(KEY)
    sums = histogram.select(
        KEY,
        "v",
        F.sum("n").over(upto).alias("low"),
        F.sum(F.col("n") * F.col("v")).over(upto).alias("low_sum"),
        F.sum("n").over(every).alias("all"),
        F.sum(F.col("n") * F.col("v")).over(every).alias("all_sum"),
    )
    high = F.col("all") - F.col("low")
    between = F.when(high > 0, F.col("low") * high * F.pow(F.col("low_sum") / F.col("low") - (F.col("all_sum") - F.col("low_sum")) / F.nullif(high, F.lit(0.0)), F.lit(2.0))).otherwise(0.0)
    return sums.select(KEY, "v", F.round(between, 3).alias("between")).groupBy(KEY).agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"))


def bounding_box(pixels: DataFrame, paper: int = 250) -> DataFrame:
    """The rows and columns that hold anything darker than paper."""
    dark = pixels.filter(F.col("v") < paper)
    return dark.groupBy(KEY).agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("x").alias("left"), F.max("x").alias("right"))
