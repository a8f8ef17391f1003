"""One registered query per operator, over whole tables, and the corpus pipeline's query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remnant.llm import (
    chat_formatting,
    embedding_dedup,
    html_extraction,
    lexical_search,
    mixing,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    simhash_dedup,
    token_counts,
    tokenizer_alignment,
    toxicity,
    url_filter,
)
from remnant.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per line of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of every vector."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentation of every document: number of pieces, digest, and the round trip."""
    drawn = sentencepiece_codec.encode_checked(F.col("text"), F.col("doc_id"))
    rows = table(spark, sf_dir, "documents").select("doc_id", drawn.alias("s")).select("doc_id", "s.*")
    return rows.select(
        "doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("bigint").alias("n_pieces"),
        F.when(F.col("pieces").isNotNull(), F.xxhash64("pieces")).alias("digest"), "lossless",
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.labelled(docs, labels, ~toxicity.held_out(F.col("doc_id"))))
    rows = toxicity.score(docs, model)
    return rows.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    rows, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    s = F.col("s")
    return rows.select(
        "doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "rule"
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance and sampling decision of every document."""
    rows, _, _ = quality_classifier.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_grams", "importance", "key", "kept")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    rows = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken")
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    rows = html_extraction.extract(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_repeats")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    found = lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation and of one that says control strings."""
    said = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_formatting.digests(rows.unionByName(said))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token links of every document, weighed by how many documents hold them."""
    found, _ = tokenizer_alignment.align(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, each written and read again."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_embedding_dedup, op3_sentencepiece, op4_toxicity, op5_quality_rules, op6_quality_classifier,
        op7_simhash_dedup, op8_url_filter, op9_mixing, op10_html_extraction, op11_lexical_search,
        op12_chat_formatting, op13_tokenizer_alignment, pipeline,
    )
}

#: Words, shuffle keys and targets as in mixing.py; equal rows are peers of the running sums.
ORACLE_SQL: dict[str, str] = {
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS varchar), '') AS id,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS varchar), '')), 1, 8) AS bigint) AS h FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][(place % 3 + 1)::int]::double AS w, 2.0::double * source_size AS stop FROM p),
r AS (SELECT *, stop / w AS ratio FROM w),
f AS (SELECT *, (1.5::double * sum(source_size) OVER ()
    - coalesce(sum(stop) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
l AS (SELECT level AS l FROM f WHERE ratio >= level ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, place, source_size, CASE WHEN (SELECT l FROM l) IS NULL OR ratio < (SELECT l FROM l) THEN stop ELSE (SELECT l FROM l) * w END AS target FROM f),
c AS (SELECT d.*, t.place, t.source_size, t.target, sum(size) OVER (PARTITION BY t.place ORDER BY h, id, size) AS cum
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, k.round AS round, (cum + k.round * source_size) / target AS time FROM c CROSS JOIN (SELECT unnest([0, 1]) AS round) k WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY time, place, h, id, size, round) AS upto FROM e),
m AS (SELECT place, round, max((h, id, size)) AS last FROM g WHERE upto <= (SELECT sum(target) FROM t) GROUP BY place, round)
SELECT c.doc_id, c.size, c.source_size, c.target,
  (CASE WHEN c.size > 0 THEN c.size * ((CASE WHEN (h, id, size) <= m0.last THEN 1 ELSE 0 END) + (CASE WHEN (h, id, size) <= m1.last THEN 1 ELSE 0 END)) ELSE 0 END)::bigint AS taken
FROM c LEFT JOIN m m0 ON m0.place = c.place AND m0.round = 0 LEFT JOIN m m1 ON m1.place = c.place AND m1.round = 1""",
    "op11_lexical_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::bigint AS n_docs, sum(len(t))::bigint AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, n, term, count(*)::bigint AS tf FROM (SELECT row_number() OVER () AS r, doc_id, len(t)::bigint AS n, unnest(t) AS term FROM d) GROUP BY r, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint AS w FROM (SELECT term, count(*)::bigint AS df FROM p GROUP BY term), s),
q AS (
  SELECT item_id, term, count(*)::bigint AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
x AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, r, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::integer AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
    "op12_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '(<)(/?s>)', '\1\\\2', 'g'), '(\[)((/?(INST|OUT|SYS|ROLE)|TEXT)\])', '\1\\\2', 'g'))
    + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 18 WHEN 'assistant' THEN 18 ELSE 24 + length(
      regexp_replace(regexp_replace(replace(role, '\', '\\'), '(<)(/?s>)', '\1\\\2', 'g'), '(\[)((/?(INST|OUT|SYS|ROLE)|TEXT)\])', '\1\\\2', 'g')) END AS chars FROM c)
SELECT conv_id, count(*)::bigint AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::bigint AS formatted_chars
FROM e GROUP BY conv_id""",
}
