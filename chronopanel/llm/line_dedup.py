"""Line dedup by a log-template tree of fixed depth.

A line recurs if another document has its tokens too. Beyond that, lines that differ in variable fields recur if they
follow one template. Tokens that hold a digit, or begin with a capital A-Z and aren't the line's first, are fields, <*>.
Level one of the tree is the number of tokens, level two which of SEGMENTS equal stretches of the line may vary (or none
but the fields), level three the leading tokens up to that stretch, and the leaf the tokens after it. So a line is parsed
along a few paths, and lines that differ in one stretch, or in names and numbers, meet in a leaf. A place becomes variable
only by counts: a leaf is a template if lines with at least VARIANTS different contents reach it from at least DOCUMENTS
documents, and at least three in five of its tokens are literal. Of a recurring line or template the lines of one document
stay, that with the smallest id; the others are dropped. Two documents with lines that are merely alike lose nothing.

Contents and documents are counted by hash classes, 64 each, so that a leaf's state is two masks however many lines reach
it, and counts are never too high. Nothing depends on the order of lines: all counts are over all documents, combined
before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Stretches of a line of which one may vary, and the least tokens of a line for that.
SEGMENTS, LEAST = 4, 5
#: Classes of documents and of contents that a template takes.
DOCUMENTS, VARIANTS = 8, 8

_GAP = r"[\x20\x09-\x0D]+"
#: Fields in a line with single spaces, matched without backtracking, so that very long tokens cost linear time.
_FIELD = r"(?<= )[A-Z][^ ]*+|(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), worked out once however often use has its argument: a one-element array binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spaced(line: Column) -> Column:
    """The line's tokens with single spaces between; a line that needs no change costs one scan."""
    return F.when(F.regexp_like(line, F.lit(r"[\x09-\x0D]|  |^ | $")), F.regexp_replace(F.regexp_replace(line, _GAP, " "), "^ | $", "")).otherwise(line)


def masked(line: Column) -> Column:
    """A spaced() line with <*> for its fields."""
    return F.when(F.regexp_like(line, F.lit("[0-9]| [A-Z]")), F.regexp_replace(line, _FIELD, "<*>")).otherwise(line)


def hash_class(text: Column) -> Column:
    """0 to 63, the same for equal texts."""
    return (F.conv(F.substring(F.md5(text), 1, 2), 16, 10).cast("int") % 64).cast("int")


def paths(line: Column, segments: int = SEGMENTS, least: int = LEAST) -> Column:
    """(content, exact, leaves) of a spaced() line: the content's class, the digest of its tokens, and the digests of its
    paths through the tree. NULL for a line without tokens."""

    def of(m: Column) -> Column:
        fields = (F.length(m) - F.length(F.replace(m, F.lit("<*>"), F.lit("")))) / 3

        def leaves(t: Column) -> Column:
            n = F.size(t)
            cut = lambda s: F.floor(n * s / segments).cast("int")
            path = lambda s: F.xxhash64(n, F.lit(s), F.slice(t, F.lit(1), cut(s)), F.slice(t, cut(s + 1) + 1, n))
            none = F.array().cast("array<long>")
            one = F.when((fields > 0) & (5 * (n - fields) >= 3 * n), F.array(F.xxhash64(n, F.lit(-2), t))).otherwise(none)
            some = F.when(5 * (n - fields - F.ceil(n / segments)) >= 3 * n, F.array(*[path(s) for s in range(segments)])).otherwise(none)
            return F.when(n >= least, F.concat(one, some)).otherwise(none)

        return _bound(F.split(m, " "), leaves)

    whole = F.struct(hash_class(line).alias("content"), F.xxhash64(F.lit(-1), line).alias("exact"), _bound(masked(line), of).alias("leaves"))
    return F.when(line != "", whole)


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS, least: int = LEAST, documents: int = DOCUMENTS, variants: int = VARIANTS) -> DataFrame:
    """docs, all columns, with recurring lines cut from the text; what stays keeps its order and its line ends.

    Rows of one id are one document; repeated rows get the same result. Lines without a token stay, unless the whole
    text goes: a document that keeps no line with a token gets the text "". Null texts stay null, empty ones empty, texts of any length are read whole. Null ids take part like any
    id and count as the smallest. An empty table gives an empty result. Extra columns are passed through, whatever their
    names.
    """
    me = [F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__mark")]
    parsed = F.transform(F.transform(F.split(text_col, "\n", -1), spaced), lambda x: paths(x, segments, least))
    named = hash_class(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__class")
    lines = stored(docs.where(F.col(text_col).isNotNull()).select(*me, named, parsed.alias("__lines")), "lines")
    each = lines.select("__id", "__mark", "__class", F.posexplode("__lines").alias("__no", "__line")).where("__line is not null")
    each = each.select("__id", "__mark", "__class", "__no", F.col("__line.content").alias("__content"), F.posexplode(F.concat(F.array("__line.exact"), "__line.leaves")).alias("__at", "__path"))
    # Repeats within a document don't count.
    bit = lambda c: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c)))
    found = each.groupBy("__path").agg(
        F.min("__id").alias("__first"), F.max("__id").alias("__last"), F.count("__id").alias("__named"), F.count(F.lit(1)).alias("__all"), F.max(F.col("__at") > 0).alias("__leaf"),
        bit("__class").alias("__classes"), bit("__content").alias("__contents"),
    )
    exact = (F.col("__first") != F.col("__last")) | ((F.col("__named") > 0) & (F.col("__named") < F.col("__all")))
    recurs = F.when(F.col("__leaf"), (F.bit_count("__classes") >= documents) & (F.bit_count("__contents") >= variants)).otherwise(exact)
    templates = stored(found.where(recurs).select("__path", F.when(F.col("__named") == F.col("__all"), F.col("__first")).alias("__first")), "templates")
    gone = each.join(templates, "__path").where(~F.col("__id").eqNullSafe(F.col("__first"))).groupBy("__id", "__mark").agg(F.collect_set("__no").alias("__gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *me)
    joined = rows.alias("d").join(gone.alias("g"), F.expr("d.__id <=> g.__id and d.__mark = g.__mark"), "left")
    text = F.col("__row").getField(text_col)
    stay = _bound(F.split(text, "\n", -1), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__gone")), lambda i: F.get(ls, i)), "\n"))
    left = _bound(stay, lambda t: F.when(F.regexp_like(t, F.lit(r"[^\x20\x09-\x0D]")), t).otherwise(""))
    text = F.when(F.col("__gone").isNull(), text).otherwise(left)
    return joined.select(*[(text if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns])
