"""URL filters: rules on hosts and paths, matched by a sorted sweep over canonical keys.

A rule is `host` or `host/path`. It fits its host and every subdomain, if the url's path starts with the rule's
path; the longest rule string that fits wins. Host labels are reversed ("example.org" becomes "org/example/"), so
a host with its subdomains is one interval of keys, and below one host a path prefix is one interval too. Intervals
made from prefixes are nested or disjoint, so a sweep in key order needs a stack of the rules that are open. Here the
stack is two windows over the sorted events: a running sum of +1 (rule opens) and -1 (rule closes) is the stack's
depth, and the last rule that opened at the current depth is the stack's top.

Two sweeps run: urls against the hosts that have rules, then, below each such host of a url, its path against that
host's path rules. Keys are cut into ranges of rules, and each range into salts in proportion to its urls, so that a
host with a third of all urls is spread evenly; the rules of a range (a bounded number) are repeated for each salt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, partitions

#: The production rules of the query op1.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

#: Rules in one range of keys, and the most ranges (their bounds become a literal of the plan).
RANGE_RULES, MOST_RANGES = 5000, 1023


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by a slash, which no host can hold."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))


def _range_bounds(rules: DataFrame) -> list[str]:
    """The first keys of ranges with about RANGE_RULES rules each, without that of the first range."""
    n = min(MOST_RANGES + 1, -(-rules.count() // RANGE_RULES))
    if n < 2:
        return []
    firsts = rules.repartitionByRange(n, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("first"))
    return sorted({r['first'] for r in firsts.collect()})[1:]  # at most MOST_RANGES + 1 rows


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """points (key, ...) with a column top: the payload of the innermost rule whose key is a prefix of the point's, or
    null. rules: (key, payload), one row a key."""
    spark = points.sparkSession
    bounds = _range_bounds(rules)
    literal = F.array(*map(F.lit, bounds)) if bounds else None
    steps = [1 << i for i in range(max(0, len(bounds).bit_length() - 1), -1, -1)]

    def range_of(key: Column) -> Column:
        """How many bounds are at or below key, by binary search."""
        if not bounds:
            return F.lit(0)
        return reduce(lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(literal, at + F.lit(step)) <= key), at + step).otherwise(at), steps, F.lit(0))

    placed = points.withColumn("__range", range_of(F.col("key")))
    counts = {r[0]: r[1] for r in placed.groupBy("__range").count().collect()}  # at most MOST_RANGES + 1 rows
    total, spread = max(1, sum(counts.values())), 2 * partitions(spark)
    salts = F.array(*[F.lit(1 + counts.get(i, 0) * spread // total) for i in range(len(bounds) + 1)])

    here = rules.withColumn("__range", range_of(F.col("key")))
    if bounds:  # a rule that is open where a range begins belongs to that range too
        cuts = spark.createDataFrame([(i + 1, b) for i, b in enumerate(bounds)], "__range int, cut string")
        heads = cuts.select("__range", F.explode(F.expr("transform(sequence(1, length(cut)), i -> substring(cut, 1, i))")).alias("key"), "cut").where("key <> cut")
        here = here.unionByName(heads.select("__range", "key").join(rules, "key"), allowMissingColumns=True)
    here = here.withColumn("__salt", F.explode(F.sequence(F.lit(1), F.element_at(salts, F.col("__range") + 1))))
    at = F.to_binary("key", F.lit("utf-8"))
    opens = here.select("__range", "__salt", at.alias("__at"), F.lit(0).alias("__kind"), F.lit(1).alias("__step"), F.col("payload").alias("__rule"))
    # 0xFF is in no UTF-8 text, so key || 0xFF closes the interval of all keys that begin with key.
    closes = here.select("__range", "__salt", F.concat(at, F.unhex(F.lit("FF"))).alias("__at"), F.lit(2).alias("__kind"), F.lit(-1).alias("__step"))
    row = F.struct(*points.columns)
    rows = placed.select(
        "__range", (F.pmod(F.xxhash64(*[points[c] for c in points.columns]), F.element_at(salts, F.col("__range") + 1)) + 1).cast("int").alias("__salt"),
        at.alias("__at"), F.lit(1).alias("__kind"), F.lit(0).alias("__step"), row.alias("__row"),
    )
    events = opens.unionByName(closes, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    order = [F.col("__at"), F.col("__kind")]
    depth = F.sum("__step").over(Window.partitionBy("__range", "__salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    top = F.last("__rule", ignorenulls=True).over(Window.partitionBy("__range", "__salt", "__depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    swept = events.withColumn("__depth", depth).withColumn("__top", top).where("__kind = 1")
    return swept.select("__row.*", F.when(F.col("__depth") > 0, F.col("__top")).alias("top"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: id, host, path, rule (null if none fits), verdict (the rule's action, else default).

    rules: (rule, action). Null and empty rules are ignored; of equal rules the greater action string wins, so
    block beats allow. A url that is null or has no "://" has an empty host and path and gets the default. Null ids
    and repeated rows are kept as they are. Other columns of pages are not read.
    """
    known = (
        rules.where("rule is not null and rule <> ''").groupBy(ascii_host_rule(F.col("rule")).alias("rule")).agg(F.max("action").alias("action"))
        .withColumn("__node", host_key(F.substring_index("rule", "/", 1)))
        .withColumn("__path", F.expr("if(instr(rule, '/') > 0, substring(rule, instr(rule, '/')), '')"))
    )
    # Each host with rules, and the hosts with rules above it, itself included.
    nodes = known.select("__node").distinct()
    above = nodes.select("__node", F.explode(F.expr("transform(sequence(1, size(split(__node, '/')) - 1), i -> concat(array_join(slice(split(__node, '/'), 1, i), '/'), '/'))")).alias("up"))
    chains = above.join(nodes.select(F.col("__node").alias("up")), "up").groupBy("__node").agg(F.collect_list("up").alias("payload"))  # at most one a label
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).groupBy("id", "url").agg(F.count(F.lit(1)).alias("times"))
    hosts = sweep(urls.withColumn("key", host_key(url_host(F.col("url")))), chains.select(F.col("__node").alias("key"), "payload"))
    probes = hosts.select("id", "url", "times", F.explode_outer("top").alias("node")).withColumn("key", F.concat_ws("?", F.coalesce("node", F.lit("")), url_path(F.col("url"))))
    wanted = known.select(F.concat_ws("?", "__node", "__path").alias("key"), F.struct(F.length("rule").alias("size"), "rule", "action").alias("payload"))
    best = sweep(probes, wanted).groupBy("id", "url", "times").agg(F.max("top").alias("top"))
    return best.select(
        F.col("id").alias(id_col), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("top.rule").alias("rule"),
        F.coalesce("top.action", F.lit(default)).alias("verdict"), F.explode(F.expr("sequence(1L, times)")).alias("__copy"),
    ).drop("__copy")


def ascii_host_rule(rule: Column) -> Column:
    """The rule with its host in lower case."""
    return F.concat(ascii_lower(F.substring_index(rule, "/", 1)), F.expr("if(instr(rule, '/') > 0, substring(rule, instr(rule, '/')), '')"))
