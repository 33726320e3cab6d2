"""Audit of how filters interact, by the potential of the game in which coalitions of filters remove documents.

A document has a mask of the filters it fails. Coalition S removes every document whose mask meets S, so the worth v(S)
of all coalitions follows from the counts by mask alone, 32 numbers a part for five filters. The potential P of the game
is P(no filter) = 0 and P(S) = (v(S) + sum of P(S without i) over the i of S) / |S|; a filter's Shapley value is P(all)
less P(all without it). Whole numbers are kept by carrying factorial(n) * P, which every |S| divides. What a filter does
at its step in an order is the difference of the worth of two coalitions: those before it with and without it.

Only counts travel: rows of ids, digests and masks are summed by digest (to see which copy is the first) and by mask.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def bound(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with value worked out once: a one-element array binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_filters(text: Column) -> Column:
    """The mask of the four filters on a text alone, bits 1, 2, 4 and 8: under 200 words; fewer distinct words than half
    of all; over two capitals A-Z in a hundred code points; any of #$%&*|."""

    def masked(words: Column) -> Column:
        n = F.size(words)
        few = F.when(n < 200, 1).otherwise(0)
        return few + F.when(100 * F.size(F.array_distinct(words)) < 50 * n, 2).otherwise(0)

    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    rest = F.when(100 * capitals > 2 * F.length(text), 4).otherwise(0) + F.when(F.regexp_like(text, F.lit("[#$%&*|]")), 8).otherwise(0)
    return bound(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), masked) + rest


def mask_counts(docs: DataFrame, mask: Column, copies: int, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part: Column | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail; bit `copies` is set for texts that a smaller id has.

    mask is an expression over the columns of docs. labels: (id, quality, toxic), of which several rows may name a document;
    one that says so is enough. Equal rows of one id are no copies of each other. A null id is neither smaller nor larger
    than any, and has no label.
    """
    name = F.coalesce((part if part is not None else F.lit("")).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), name.alias("part"), mask.alias("mask"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))
    if labels is None:
        known = rows.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    else:
        said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        known = rows.join(said, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    alike = ["digest", "part", "mask", "good", "toxic"]
    # Sums by id, then the least id of each kind with its rows: a text that a third of all rows share is a few rows here.
    each = known.groupBy("id", *alike).agg(F.count(F.lit(1)).alias("n"))
    kinds = each.groupBy(*alike, F.col("id").isNull().alias("unnamed")).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    stay = F.when(F.col("unnamed"), F.col("n")).when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = kinds.withColumn("least", least).withColumn("stay", stay)
    both = F.array(F.struct("mask", F.col("stay").alias("n")), F.struct(F.col("mask").bitwiseOR(copies).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    cells = split.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def worths(cells: Column, what: str, n: int) -> Column:
    """The worth of all coalitions, an array by the coalition's bits: documents whose mask meets it."""
    met = lambda s: F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + F.when(c["mask"].bitwiseAND(s) != 0, c[what]).otherwise(0))
    return F.transform(F.sequence(F.lit(0), F.lit(2**n - 1)), met)


def potentials(worth: Column, n: int) -> Column:
    """factorial(n) times the potential of all coalitions, each from those with one filter less; all are whole numbers."""

    def grown(known: Column, s: Column) -> Column:
        less = sum((F.when(s.bitwiseAND(1 << i) != 0, F.get(known, s - (1 << i))).otherwise(0) for i in range(n)), F.lit(0).cast("long"))
        whole = F.get(worth, s) * math.factorial(n) + less
        return F.concat(known, F.array(F.call_function("div", whole, F.bit_count(s))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2**n - 1)), F.array(F.lit(0).cast("long")), grown)


def audit(counts: DataFrame, filters: str) -> DataFrame:
    """counts (part, mask, n, good, toxic), filters one letter a bit -> a row a part, order of the filters and step.

    kept (after the step), removed (by it), redundant (fail it, removed earlier), unique_fails (fail it only), good_lost,
    toxic_lost (removed by it), shapley (removed by it, summed over all orders). Every part that has a document has all
    rows, zeros included; an empty table gives none.
    """
    n, full = len(filters), 2 ** len(filters) - 1
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"), F.sum("n").alias("total"))  # at most 2^n cells
    parts = parts.select("part", "total", *[worths(F.col("cells"), c, n).alias(f"v_{c}") for c in ("n", "good", "toxic")])
    parts = parts.withColumn("potential", potentials(F.col("v_n"), n))
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])).alias("filter_order")
    steps = parts.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bits = lambda names: sum((F.when(F.contains(names, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    steps = steps.withColumns({"before": bits(F.col("filter_order").substr(F.lit(1), F.col("step") - 1)), "me": bits(letter)})
    after, others = F.col("before") + F.col("me"), F.lit(full) - F.col("me")
    at = lambda c, s: F.get(F.col(c), s)
    removed = lambda c: at(c, after) - at(c, F.col("before"))
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - at("v_n", after)).alias("kept"), removed("v_n").alias("removed"), (at("v_n", F.col("me")) - removed("v_n")).alias("redundant"),
        (at("v_n", F.lit(full)) - at("v_n", others)).alias("unique_fails"), removed("v_good").alias("good_lost"), removed("v_toxic").alias("toxic_lost"),
        (at("potential", F.lit(full)) - at("potential", others)).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame | None, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The audit of the four text filters A to D and of E, copies of a smaller id's text, by part.

    Null texts count as empty, which fail A only (and E, if a smaller id has one). Null parts are the name "". Rows are
    counted as they stand, repeated ones too; texts are read whole, whatever their length. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return audit(mask_counts(docs, text_filters(text), 16, labels, id_col, text_col, part), "ABCDE")
