"""Allow and block rules on hosts and paths, judged by one sorted sweep.

A host's labels in reverse order, each followed by a dot, and then the path are a rule's canonical key. A rule fits a
url if its key is a prefix of the url's key, made with the rule's host: so each rule is an interval of keys, and of two
intervals one holds the other or they are apart. A url has a key for its host and for each domain above it. These keys
and the ends of the intervals are sorted together and swept: where an interval starts its rule comes on top of the
stack of active ones, where it ends the rule around it is on top again. So only the top needs to be carried along, and
from one range of the sort to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, remove, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z lower-cased; empty without ://."""
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def key_of(labels: Column, path: Column) -> Column:
    """The canonical key of reversed labels and a path, in bytes, which sort as the sweep needs it."""
    return F.concat(F.array_join(labels, "."), F.lit("."), path).cast("binary")


def intervals(rules: DataFrame) -> DataFrame:
    """key, top: from that key on this rule is the innermost that is active. rules: rule (host, then path from the first
    /), verdict. Each rule gives a row at its key, and one behind all keys that start with it, where the rule around it
    (or none: a rule of null) is on top again."""
    one = F.struct("rule", "verdict", F.length("rule").alias("length"), F.length("host").alias("host_length"))
    own = rules.select(
        F.substring_index("rule", "/", 1).alias("host"),
        F.when(F.instr("rule", "/") > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("path"),
        "rule",
        "verdict",
    )
    # Of a rule given both ways, blocking counts; "x" and "x." are no two hosts, but rules are distinct as texts.
    own = own.groupBy("host", "path", "rule").agg(F.min_by("verdict", F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("verdict"))
    own = cut(own.select(key_of(F.reverse(F.split("host", r"\.")), F.col("path")).alias("key"), one.alias("top")))
    shorter = own.select("key", F.explode(F.expr("transform(sequence(1, greatest(octet_length(key) - 1, 1)), i -> substring(key, 1, i))")).alias("prefix"))
    around = shorter.filter("prefix <> key").join(own.select(F.col("key").alias("prefix"), F.col("top").alias("outer")), "prefix")
    around = around.groupBy("key").agg(F.max_by("outer", F.octet_length("prefix")).alias("outer"))
    none = F.lit(None).cast(own.schema["top"].dataType)
    ends = own.join(around, "key", "left").select(
        F.concat("key", F.lit(b"\xff")).alias("key"),
        F.struct(*[F.coalesce(F.col("outer"), none)[f].alias(f) for f in own.schema["top"].dataType.names]).alias("top"),
    )
    return own.unionByName(ends)


def judge(df: DataFrame, rules: DataFrame, url: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to the kept columns.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. Of the rules that
    fit the longest wins; of equally long ones the one of the longer host, and of one rule given both ways the
    blocking one. Without a rule, rule is null and verdict the default. A null url, or one without ://, has an empty
    host and path, which no rule fits. Repeated rows stay repeated; an empty table stays empty; with no rules all
    get the default. Kept columns named like a new one are replaced.

    Keys are dealt to tasks by ranges, equal ones (of a hot host, say) by the row as well, so that no task gets all
    of one host; rules are not copied, and what crosses from range to range is one rule a task. A row's kept columns go
    with its host's own key alone.
    """
    spark, folders = df.sparkSession, []
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    urls = df.select(F.struct(*[F.col(f"`{c}`") for c in kept], host_of(address).alias("host"), path_of(address).alias("path")).alias("row"), F.monotonically_increasing_id().alias("number"))
    labels = F.reverse(F.split("row.host", r"\."))
    urls = urls.select("number", "row", labels.alias("labels"), F.explode(F.expr("sequence(size(split(row.host, '[.]')), 1)")).alias("n"))
    urls = urls.select(
        key_of(F.slice("labels", F.lit(1), F.col("n")), F.col("row.path")).alias("key"),
        F.lit(1).alias("is_url"),
        "number",
        F.when(F.col("n") == F.size("labels"), F.col("row")).alias("row"),
    )
    events = intervals(rules).select("key", F.lit(0).alias("is_url"), F.lit(0).cast("long").alias("number"), "top")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = urls.unionByName(events, allowMissingColumns=True).repartitionByRange(parts, "key", "is_url", "number")
    both = staged(both.withColumn("part", F.spark_partition_id()), folders, "ranges")
    # The rule on top at the end of each range: one row a task.
    last = both.filter("is_url = 0").groupBy("part").agg(F.max_by("top", "key").alias("top")).orderBy("part").collect()
    carried = [(part, max((r for r in last if r.part < part), key=lambda r: r.part, default=None)) for part in range(parts)]
    carry = spark.createDataFrame([(p, r.top if r else None) for p, r in carried], f"part int, carried {both.schema['top'].dataType.simpleString()}")
    top = F.last("top", ignorenulls=True).over(Window.partitionBy("part").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0))
    swept = both.withColumn("active", top).filter("is_url = 1").join(F.broadcast(carry), "part")
    rank = F.coalesce("active", "carried")
    hit = F.when(rank["rule"].isNotNull(), F.struct(rank["length"].alias("length"), rank["host_length"].alias("host_length"), rank["rule"].alias("rule"), rank["verdict"].alias("verdict")))
    found = swept.select("number", "row", hit.alias("hit")).groupBy("number").agg(F.max("hit").alias("hit"), F.first("row", ignorenulls=True).alias("row"))
    out = cut(found.select("row.*", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")))
    for folder in folders:
        remove(spark, folder)
    return out
