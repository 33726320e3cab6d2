"""Mixing sources to target weights by hierarchical budgets over a domain-language-source tree.

Budgets run down the tree from the total: at each node the children share its budget in proportion to their weights,
but none gets more than its subtree can supply (its tokens times the epochs allowed). What a child cannot supply goes
to its siblings first; only what all of them together cannot supply is left to the siblings of their parent, because a
node's own cap is what its whole subtree can supply. For one set of siblings this is a water level: with children in
order of supply/weight, those whose ratio is below the level give all they have, the others weight times level.

Each leaf then takes whole documents in the order of a seeded hash, epoch by epoch with a new order in each, until its
budget is reached: all documents whose tokens before them in that order are under the budget.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEVELS = ("domain", "lang", "source")

#: Rows of one bucket of the seeded order, about: running sums are made over buckets, then inside of one.
BUCKET = 20_000


def word_count(text: Column) -> Column:
    """The text's words, as tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share(children: DataFrame, by: list[str]) -> DataFrame:
    """Adds budget to children (by..., supply, weight, total): total shared out among the rows of equal by.
    A child of weight 0 must have the supply 0."""
    ratio = Window.partitionBy(*by).orderBy(F.col("__ratio"), F.col("__name"))
    group = Window.partitionBy(*by)
    # Children of weight 0 come with nothing to supply and stand first, so that they change no sum.
    c = children.withColumn("__ratio", F.coalesce(F.try_divide("supply", "weight"), F.lit(0.0)))
    full = F.coalesce(F.sum("supply").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing))
    # The level if this child and all after it are not exhausted; the first child whose ratio reaches it sets it.
    c = c.withColumn("__level", F.when(F.col("weight") > 0, (F.col("total") - full) / rest))
    level = F.min(F.when(F.col("__ratio") >= F.col("__level"), F.struct("__ratio", "__name", "__level"))).over(group)["__level"]
    return c.withColumn("budget", F.when(level.isNull(), F.col("supply")).otherwise(F.greatest(F.lit(0.0), F.least(F.col("supply"), F.col("weight") * level)))).drop("__ratio", "__level")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict], total: Column, epochs: int) -> DataFrame:
    """leaves: (domain, lang, source, tokens) -> the same with budget. weights: for each level, name -> weight; names
    that are not listed have weight 1, those of weight 0 and all below them get nothing; negative ones are an error."""
    if any(w < 0 for level in weights.values() for w in level.values()):
        raise ValueError("negative weight")

    def given(level: str) -> Column:
        named = [F.lit(x) for k, v in weights.get(level, {}).items() for x in (k, float(v))]
        return F.coalesce(F.create_map(*named)[F.col(level)], F.lit(1.0)) if named else F.lit(1.0)

    wanted = reduce(lambda a, b: a & b, [given(level) > 0 for level in LEVELS])
    tree = leaves.withColumn("supply", F.when(wanted, F.col("tokens").cast("double") * epochs).otherwise(0.0))
    budgets = leaves.sparkSession.range(1).select(total.cast("double").alias("total"))
    above: list[str] = []
    for level in LEVELS:
        at = [*above, level]
        nodes = tree.groupBy(*at).agg(F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("weight", given(level)).withColumn("__name", F.col(level))
        nodes = nodes.crossJoin(budgets) if not above else nodes.join(budgets, above)  # budgets has one row at the root
        budgets = share(nodes, above or [F.lit(0)]).select(*at, F.col("budget").alias("total"))
        above = at
    return leaves.join(budgets.withColumnRenamed("total", "budget"), list(LEVELS))


def mix(
    docs: DataFrame, weights: dict[str, dict], fraction: float, epochs: int = 1, seed: int = 42, domain: Column | None = None,
    tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """The documents of the mixture, one row for each epoch that takes one: columns keep (default: all), __mix with
    domain, lang, source, epoch (from 1), n_tokens and before (tokens ahead of it in its leaf).

    The total budget is fraction times all tokens. tokens: count of a document (default: words of the whole text; null
    texts have 0). Documents without tokens cost nothing and come with whatever stands before the budget's end. Null
    domain, lang and source are the name "". Ties in the seeded order fall to the id (nulls first), then the text's
    hash; rows equal in all of these stand together, each counted. Empty input gives an empty result.
    """
    seeded = lambda e: F.md5(F.concat_ws(":", F.lit(str(seed)), e, F.coalesce(F.col("__id").cast("string"), F.lit(""))))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    # Texts are read and counted once; what follows reads the columns it needs of the stored rows.
    once = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__mark"),
        name(domain if domain is not None else F.lit("all")).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"),
        (tokens if tokens is not None else word_count(F.col(text_col))).cast("long").alias("n_tokens"),
    )
    once = stored(once, "mixing")
    digits = 3
    while once.count() > BUCKET * 16**digits:
        digits += 1
    rows = once.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("__key", seeded(F.col("epoch").cast("string")))
    rows = rows.withColumn("__bucket", F.conv(F.substring("__key", 1, digits), 16, 10).cast("int"))
    leaf = list(LEVELS)
    sums = stored(rows.groupBy(*leaf, "epoch", "__bucket").agg(F.sum("n_tokens").alias("__sum")), "sums")
    total = sums.where("epoch = 1").agg((F.coalesce(F.sum("__sum"), F.lit(0)) * fraction).alias("t")).first()[0]
    leaves = sums.where("epoch = 1").groupBy(*leaf).agg(F.sum("__sum").alias("tokens"))
    ahead = F.sum("__sum").over(Window.partitionBy(*leaf).orderBy("epoch", "__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")
    open_buckets = sums.withColumn("__ahead", ahead).join(leaf_budgets(leaves, weights, F.lit(float(total)), epochs), leaf).where("__ahead < budget").select(*leaf, "epoch", "__bucket", "__ahead", "budget")
    inside = Window.partitionBy(*leaf, "epoch", "__bucket").orderBy("__key", "__id", "__mark").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(open_buckets, [*leaf, "epoch", "__bucket"]).withColumn("before", F.col("__ahead") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).where("before < budget")
    return placed.select("row.*", F.struct(*leaf, "epoch", "n_tokens", "before").alias("__mix"))
