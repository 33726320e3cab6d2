"""The corpus operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, filter_audit, fingerprints, katz, license_scan, line_dedup, mixing, quality, resampling, simhash, token_counts, topk, url_filter
from .common import table

#: Where the public tokenizers' files are; a parameter of the operators, here their package's own answer.
OVER_LIMIT = 1024

#: The mixture's production weights: domains, languages, sources; what is not named has weight 1.
MIX_WEIGHTS = {"domain": {"crawl": 1.0, "curated": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {"src1": 2.0, "src2": 0.5}}
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = 0.6, 2, 42


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def domain_of_source():  # noqa: ANN201
    """src0 is the crawl, all others are curated."""
    return F.when(F.col("source") == "src0", "crawl").otherwise("curated")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(url_filter.RULES, "rule string, action string"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.cached_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), token_counts.new_cache(spark))
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(c, ",").alias(c)
    return license_scan.scan(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", text("base_labels"), text("labels"), "score")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    trip = byte_bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.tiktoken"), word_pattern())
    return trip.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return katz.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).withColumnRenamed("id", "doc_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED, domain_of_source(), keep=["doc_id"])
    return mixed.select("doc_id", *[F.col(f"__mix.{c}").alias(c) for c in ("domain", "lang", "source", "epoch", "n_tokens", "before")])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("id", "doc_id")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.chained(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_url_filters, op2_token_counts, op3_simhash, op4_quality_rules, op5_topk, op6_license_scans, op7_byte_bpe, op8_katz, op9_line_dedup, op10_mixing)
    return {f.__name__: f for f in (*first, op11_filter_audit, op12_resampling, op13_fingerprints)}


_URLS = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') END,
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
rules(rule, action, rh, rp) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/'))
SELECT p.page_id, p.host, p.path,
       (SELECT arg_max(rule, length(rule)) FROM rules r WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)) AS rule,
       coalesce((SELECT arg_max(action, length(rule)) FROM rules r WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)), 'allow') AS verdict
FROM parts p
"""

_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) q JOIN v x ON q.vec_id <> x.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

_LINES = r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, no, line, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS leaf FROM l),
m AS (SELECT *, list_transform(string_split(leaf, ' '), lambda x, i: CASE WHEN regexp_matches(x, '[0-9]') OR i > 1 AND regexp_matches(x, '^[A-Z]') THEN '<*>' ELSE x END) AS t FROM t WHERE leaf <> ''),
w AS (SELECT *, len(t) AS n, array_to_string(t, ' ') AS masked, (length(masked) - length(replace(masked, '<*>', ''))) / 3 AS f,
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2))::INTEGER % 64 AS dc, ('0x' || substr(md5(leaf), 1, 2))::INTEGER % 64 AS vc FROM m),
p AS (SELECT doc_id, no, n, s, dc, vc, CASE s WHEN -1 THEN leaf WHEN -2 THEN masked ELSE array_to_string(t[:n * s // {segments}], ' ') || ' <*> ' || array_to_string(t[n * (s + 1) // {segments} + 1:], ' ') END AS path
  FROM (SELECT *, unnest(list_concat([-1], CASE WHEN n >= {least} AND f > 0 AND 5 * (n - f) >= 3 * n THEN [-2] ELSE [] END,
    CASE WHEN n >= {least} AND 5 * (n - f - ceil(n / {segments})) >= 3 * n THEN range({segments}) ELSE [] END)) AS s FROM w)),
r AS (SELECT n, s, path, min(doc_id) AS first FROM p GROUP BY ALL
  HAVING CASE WHEN s = -1 THEN count(DISTINCT doc_id) > 1 ELSE count(DISTINCT dc) >= {documents} AND count(DISTINCT vc) >= {variants} END),
x AS (SELECT DISTINCT doc_id, no FROM p JOIN r USING (n, s, path) WHERE doc_id <> first),
k AS (SELECT t.* FROM t ANTI JOIN x USING (doc_id, no)),
g AS (SELECT doc_id, CASE WHEN max(leaf) <> '' THEN string_agg(line, chr(10) ORDER BY no) ELSE '' END AS text, count(*) AS n FROM k GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN g.n = n.n THEN d.text ELSE coalesce(g.text, '') END AS text, d.lang, d.source, d.n_chars
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)
""".format(segments=line_dedup.SEGMENTS, least=line_dedup.LEAST, documents=line_dedup.DOCUMENTS, variants=line_dedup.VARIANTS)


def _share_sql(name: str, above: list[str], level: str, weights: str) -> str:
    """SQL of one level of the budgets: the water level as the least ratio at which all of the total is used."""
    at = ", ".join([*above, level])
    by = ", ".join(above) or "1"
    joined = " AND ".join(f"s.{c} = b.{c}" for c in above) or "true"
    source = "root" if not above else f"b_{above[-1]}"
    return f"""
n_{level} AS (SELECT {", ".join(f"s.{c}" for c in [*above, level])}, s.supply, b.budget AS total, {weights} AS weight
  FROM (SELECT {at}, sum(supply) AS supply FROM leaves GROUP BY {at}) s JOIN {source} b ON {joined}),
w_{level} AS (SELECT *, supply / weight AS ratio,
  (total - coalesce(sum(supply) OVER (PARTITION BY {by} ORDER BY supply / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (PARTITION BY {by} ORDER BY supply / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM n_{level}),
x_{level} AS (SELECT *, arg_min(CASE WHEN ratio >= lvl THEN lvl END, CASE WHEN ratio >= lvl THEN row(ratio, {level}) END) OVER (PARTITION BY {by}) AS level FROM w_{level}),
b_{level} AS (SELECT {at}, CASE WHEN level IS NULL THEN supply ELSE greatest(0.0, least(supply, weight * level)) END AS budget FROM x_{level})"""


def _weight_case(level: str) -> str:
    return f"CASE s.{level} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in MIX_WEIGHTS[level].items()) + " ELSE CAST(1 AS DOUBLE) END"


def _mix_sql() -> str:
    levels = list(mixing.LEVELS)
    shares = ",".join(_share_sql(x, levels[:i], x, _weight_case(x)) for i, x in enumerate(levels))
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) * {MIX_EPOCHS} AS supply FROM d GROUP BY ALL),
root AS (SELECT CAST(sum(n_tokens) AS DOUBLE) * CAST({MIX_FRACTION} AS DOUBLE) AS budget FROM d),{shares},
e AS (SELECT d.*, CAST(epoch AS INTEGER) AS epoch, md5('{MIX_SEED}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM d, range(1, {MIX_EPOCHS + 1}) t(epoch)),
p AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS BIGINT) AS before FROM e)
SELECT doc_id, p.domain, p.lang, p.source, epoch, n_tokens, before FROM p JOIN b_source b ON p.domain = b.domain AND p.lang = b.lang AND p.source = b.source WHERE before < budget
"""


#: The audit by its definition: every order, every step, every document's mask.
_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copy FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN copy THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits FROM f f1, f f2, f f3, f f4, f f5
  WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31 AND len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS me, coalesce(list_sum(bits[:step - 1]), 0)::INTEGER AS before FROM o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, step, me, sum(CASE WHEN mask & (before | me) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & me <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & me <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = me THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & me <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & me <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, me) AS BIGINT) AS shapley FROM r
"""

#: CRC-32 byte by byte over the distinct features, with its table from the rule.
_RESAMPLE = r"""
WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
x AS (SELECT doc_id AS id, text, true AS mine FROM documents UNION ALL SELECT item_id, text, false FROM benchmark),
w AS (SELECT row_number() OVER () AS no, id, mine, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
e AS (SELECT no, mine, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
n AS (SELECT no, mine, f, count(*) AS n FROM e GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda c, k: xor(tab[CAST(xor(c, k) & 255 AS BIGINT) + 1], c >> 8)), 4294967295) % 10000 AS b FROM h, tab),
k AS (SELECT no, mine, b, sum(n) AS n FROM n JOIN b USING (f) GROUP BY ALL),
t AS (SELECT b, CAST(coalesce(sum(n) FILTER (mine), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (NOT mine), 0) AS DOUBLE) AS t FROM k GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM t),
v AS (SELECT no, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM k JOIN g USING (b) WHERE mine GROUP BY no),
d AS (SELECT id AS doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
  (CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296 AS u FROM w LEFT JOIN v USING (no) WHERE mine),
z AS (SELECT doc_id, words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 THEN CASE WHEN r <= 25 * N // 100 THEN r END END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY words >= 20) AS N FROM z)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": _URLS, "op5_topk": _TOPK, "op9_line_dedup": _LINES, "op10_mixing": _mix_sql(), "op11_filter_audit": _AUDIT, "op12_resampling": _RESAMPLE}
