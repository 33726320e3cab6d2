"""A corpus pipeline of five operators, each stage over all that the one before it kept.

run(spark, sf_dir) applies STAGES to the table documents. Each stage takes (spark, docs, sf_dir) and gives a DataFrame;
its result is written as Parquet in the shared folder and read again as the next one's docs. All but the last stage
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import line_dedup, mixing, quality, queries, simhash
from chronopanel.llm.common import forget, stored, table

#: Near copies: shingles of five words, Jaccard similarity of 0.8 or more. Fingerprints that differ in at most 7 of 64 bits
#: are the first pass; an exact join finds what lies beyond them.
NEAR = {"words": 5, "distance": 7, "segments": 16, "jaccard": 0.8}

#: The mixture: half of what is left, no document twice.
MIX_FRACTION, MIX_EPOCHS = 0.5, 1


def _rows(docs: DataFrame) -> Column:
    """Whole rows as one column, so that no name among the documents' columns can clash with one of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, rows as they came.

    The verdict depends on the text and on the votes of all documents. Null, empty and short texts fail the base check
    and go; very long ones are judged whole. Null ids and other nulls, ties and repeated rows change nothing: rows of
    equal texts stay or go together. An empty table gives an empty result. Extra columns stay, whatever their names.
    """
    return quality.judge(docs.select(_rows(docs).alias("row"), "text"), id_col="row", store=False).where("kept").select("id.*")


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without recurring lines; one that has nothing else left goes.

    A recurring line stays in the document with the smallest id. Documents with null or empty texts go. Rows of one id
    are one document; null ids are one as well, the smallest. Repeated rows get equal results. Long texts are read
    whole. An empty table gives an empty result. Extra columns stay, whatever their names.
    """
    return line_dedup.drop_recurring_lines(docs).where("text <> ''")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id, of one id that with the smallest digest of its text.

    Rows with equal id and text are one document, of which one row stays. Null ids come before all others; null and empty
    texts are copies of each other. Long texts are compared whole. An empty table gives an empty result. Extra columns
    stay, whatever their names.
    """
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest")).alias("key"), "text", _rows(docs).alias("row"))
    found = simhash.near_duplicates(keyed, id_col="key", **NEAR)
    gone = found.where(~F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("key")).distinct()
    return keyed.join(gone, "key", "left_anti").dropDuplicates(["key"]).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture by domain, language and source: of each leaf whole documents in seeded order up to its
    budget.

    Null languages and sources are a name of their own; null and empty texts have no tokens and come with what stands
    before the budget's end; null ids take part. Ties in the order fall to the id, then the text's hash; repeated rows
    stand together, each counted. A very long document may reach beyond its leaf's budget, as the last one. An empty
    table gives an empty result. Extra columns stay, unless one is called __mix.
    """
    return mixing.mix(docs, queries.MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, queries.MIX_SEED, queries.domain_of_source()).drop("__mix")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document's ids and of the text they decode to.

    Null and empty texts have no ids; null ids and repeated rows are kept as they are, a row each; long texts are encoded
    whole. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    return queries.bpe_digests(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_templates), ("simhash_near_dedup", near_copies), ("mixing", mixture), ("byte_bpe", encoded)]

#: Posterior probabilities and near copies are beyond SQL; tests/llm/test_pipeline.py works the stages out by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each one wrote goes when the next has read it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        after = stored(stage(spark, docs, sf_dir), name)
        if i:
            forget(spark, docs)
        docs = after
    return docs
