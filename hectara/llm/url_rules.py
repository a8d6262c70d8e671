"""URL rules by a sort-merge range join.

Reversed host labels, each ended by a dot, make a host and its subdomains one interval of text order; the paths
under a host do the same. A sweep over the sorted keys keeps the stack of rules that are open: a rule's start
pushes it, its end gives back the rule around it, which is known from the rules alone. Every point takes the top of
the stack. Ranges of the order are swept in parallel; what is open at the start of a range is the last event before
it. Distinct hosts and paths are swept, not pages, so a hot host is one point. DataFrame functions only.

Defined results: a null url or one without :// has an empty host and path and fits no rule; a rule fits its host and
all subdomains if the path of the url starts with its path (case counts); the longest rule text wins, then the
longer host, then block; no rule gives the default verdict; empty tables give empty results or defaults.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hectara.session import cut_lineage, sized_broadcast

ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """org.example.blog. for blog.example.org; subdomains of a host start with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def innermost(points: DataFrame, starts: DataFrame) -> DataFrame:
    """For each distinct point k the longest text p of `starts` that k begins with, as columns k and p; points without one are left out."""
    starts = cut_lineage(starts.select("p").distinct())
    prefixes = starts.select("p", F.explode(F.expr("transform(sequence(0, length(p)), i -> substring(p, 1, i))")).alias("q")).filter("length(q) < length(p)")
    around = prefixes.join(starts.select(F.col("p").alias("q")), "q").groupBy("p").agg(F.max(F.struct(F.length("q").alias("n"), "q")).alias("a"))
    nested = cut_lineage(starts.join(around, "p", "left").select("p", F.col("a.q").alias("outer")))
    empty = F.lit(None).cast("string")
    events = (
        nested.select(F.col("p").cast("binary").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("p").alias("p")).alias("top"), empty.alias("k"))
        .unionByName(nested.select(F.concat(F.col("p").cast("binary"), F.unhex(F.lit("FF"))).alias("at"), F.lit(0).alias("kind"), F.struct(F.col("outer").alias("p")).alias("top"), empty.alias("k")))
        .unionByName(points.select("k").distinct().select(F.col("k").cast("binary").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<p:string>").alias("top"), "k"))
    )
    ranges = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(events.repartitionByRange(ranges, "at").withColumn("range", F.spark_partition_id()))
    last = ranged.filter("kind = 0").groupBy("range").agg(F.max(F.struct("at", "top")).alias("last"))
    every = ranged.select("range").distinct().join(last, "range", "left")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sized_broadcast(every.select("range", F.last("last.top", ignorenulls=True).over(earlier).alias("carried")))
    sweep = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("open", F.last("top", ignorenulls=True).over(sweep)).filter("kind = 1").join(carried, "range")
    return swept.select("k", F.coalesce("open", "carried").getField("p").alias("p")).filter("p is not null")


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """The columns of pages (with url) and host, path, rule, verdict. rules: host, path, verdict; repeated rules count once, block before allow."""
    rules = cut_lineage(
        rules.filter("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("hk", host_key(F.col("host")))
    )
    kept = [f"`{c}`" for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    split = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = cut_lineage(split.filter("host != ''").select("host", "path").distinct())
    hosts = places.select("host").distinct().withColumn("k", host_key(F.col("host")))
    # The top of the stack names the deepest rule host; the hosts around it, pushed earlier, are its own prefixes among the rules.
    tops = innermost(hosts, rules.select(F.col("hk").alias("p")))
    levels = F.expr("transform(sequence(1, size(split(p, '[.]')) - 1), i -> concat(array_join(slice(split(p, '[.]'), 1, i), '.'), '.'))")
    stacks = cut_lineage(
        tops.select("p").distinct().select("p", F.explode(levels).alias("hk"))
        .join(rules.select("hk").distinct(), "hk", "left_semi").groupBy("p").agg(F.collect_set("hk").alias("stack"))
    )  # at most as many hosts as a host has labels
    active = (
        hosts.join(tops, "k").join(sized_broadcast(stacks), "p").select("host", F.explode("stack").alias("hk"))
    )
    joined = cut_lineage(places.join(active, "host").select("host", "path", "hk", F.concat("hk", F.lit(" "), "path").alias("k")))
    best = innermost(joined.select("k"), rules.select(F.concat("hk", F.lit(" "), "path").alias("p")))
    named = best.join(rules.select(F.concat("hk", F.lit(" "), "path").alias("p"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("n")), "p")
    ranked = F.max(F.struct(F.length("rule"), "n", "verdict", "rule")).alias("best")
    chosen = joined.join(named, "k").groupBy("host", "path").agg(ranked).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return split.join(chosen, ["host", "path"], "left").select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
