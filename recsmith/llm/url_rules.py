"""Operator 10 [native]: URL rules by a sort-merge range join with DataFrame functions only.

A host is keyed by its labels in reverse, each closed by a dot (``net.example.tionsh.``),
so "this host and all its subdomains" is an interval of keys.  Host keys and rule
openings are sorted together into ranges; sweeping a range, the last opened rule and
the rules around it are the stack, from which the ones already closed are taken off.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

RULE_SCHEMA = "host string, path string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url):
    """``(host, path)`` columns of a url column; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def host_key(host):
    """Labels in reverse, each closed by a dot; intervals of keys are domains with their subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_frame(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(host, path, verdict)`` as a DataFrame; large lists are read from a table instead."""
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def _stacks(rules: DataFrame) -> DataFrame:
    """``key, stack``: for each rule host its own rules and those of all hosts around it.

    A host has one ancestor per label, so its chain comes from equi-joins on the label
    prefixes and is as long as the rules of those hosts.
    """
    own = rules.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("size", "path", "verdict", "rule", "key"))).alias("own"))
    labels = F.split("key", r"\.")
    above = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("_up"))
    held = own.select(F.col("key").alias("_up"), F.col("own").alias("_held"))
    return above.join(held, "_up").groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("_held"))).alias("stack"))


def sweep(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``key, stack``: the rules whose host interval holds each key (keys without any are left out).

    ``keys`` are distinct host keys.  Keys and rule openings are range-partitioned
    together and swept range by range; a range starts with the last rule opened before
    it.  Ranges are checkpointed, so what they hold does not change when tasks are rerun.
    """
    opened = _stacks(rules)
    events = keys.select("key", F.lit(1).alias("kind"), F.lit(None).cast(opened.schema["stack"].dataType).alias("stack")).unionByName(
        opened.select("key", F.lit(0).alias("kind"), "stack")
    )
    ranged = cut_lineage(events.repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()))
    last = ranged.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("last"))
    # one row for each range
    ranges = ranged.groupBy("part").agg(F.count("*").alias("rows")).join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    along = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("top", F.last("stack", ignorenulls=True).over(along)).join(ranges, "part")
    # nested intervals: what is open at a key is part of the last opened rule's stack
    still = F.filter(F.coalesce("top", "carried"), lambda r: F.col("key").startswith(r["key"]))
    return swept.where("kind = 1").select("key", still.alias("stack")).where(F.size("stack") > 0)


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url by the longest fitting rule: ``page_id, host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict``; a rule fits its host and all subdomains when
    the url's path starts with the rule's.  The longest rule text wins (then the longer
    host, then ``block`` before ``allow``); urls no rule fits get ``default`` and a null
    rule.  Hosts are reduced to distinct keys before the sweep, so a host with a third of
    all pages is one row there; the rules found come back by an equi-join on the key that
    Spark broadcasts only when it is small and splits when it is skewed.

    Null urls, and urls without ``://``, have empty host and path and fit no rule.  Null
    ids and repeated rows each give a row; rules with null or empty host are ignored, a
    null path is empty; empty tables give no rows (no rules: all ``default``); other
    columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")).withColumn("key", host_key(F.col("host")))
    text = F.concat("host", "path")
    known = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host != ''")
    known = known.select(host_key(F.col("host")).alias("key"), "path", "verdict", text.alias("rule"), F.length(text).alias("size"))
    found = sweep(urls.select("key").distinct(), known).withColumnRenamed("key", "_key")
    judged = urls.join(found, F.col("key") == F.col("_key"), "left")
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), F.length(r["key"]).alias("host"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    judged = judged.withColumn("_best", best)
    return judged.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
