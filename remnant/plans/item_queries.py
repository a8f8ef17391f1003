"""Queries that choose, number, expand and validate evaluation items."""

from __future__ import annotations

from pyspark.sql import functions as F

from remnant.functions import fixed_values as V
from remnant.functions.common import let
from remnant.operators import alignment as J
from remnant.operators import quality as G
from remnant.operators import selection as P
from remnant.plans import sql as S
from remnant.plans.registry import register
from remnant.plans.sql import r, with_
from remnant.plans.views import Tables
from remnant.sources.files import index_files

_QL = with_(S.QA_LISTS)

ITEMS = S.QA_LISTS + """, files AS (SELECT DISTINCT 'img/' || CAST(page_id % 100 AS VARCHAR) AS path FROM pages),
items AS (SELECT entity, turn, CASE WHEN entity % 3 = 0 THEN 'forget' ELSE 'retain' END AS split, 'img/' || CAST(entity % 120 AS VARCHAR) AS image,
  CASE WHEN (entity + turn) % 13 <> 0 THEN question END AS question, CASE WHEN (entity + turn) % 9 = 0 THEN '' ELSE answer END AS answer FROM qa_lists)"""


def items(t: Tables):
    q = t.qa_lists()
    k = F.col("entity") + F.col("turn")
    return q.select(
        "entity", "turn",
        F.when(F.col("entity") % 3 == 0, "forget").otherwise("retain").alias("split"),
        F.concat(F.lit("img/"), (F.col("entity") % 120).cast("string")).alias("image"),
        F.when(k % 13 != 0, F.col("question")).alias("question"),
        F.when(k % 9 == 0, "").otherwise(F.col("answer")).alias("answer"),
    )


def image_files(t: Tables):
    return t.table("pages").select(
        F.concat(F.lit("img/"), (F.col("page_id") % 100).cast("string")).alias("path")
    ).distinct()


@register("p01_drop_invalid_items", with_(ITEMS) + f"""SELECT entity, turn, image, md5({S.sq('question')}) AS q, md5({S.sq('answer')}) AS a
FROM items WHERE question IS NOT NULL AND {S.sq('answer')} <> '' AND image IN (SELECT path FROM files)""")
def p01(t: Tables):
    return P.drop_invalid_items(items(t), image_files(t)).select(
        "entity", "turn", "image", F.md5("question").alias("q"), F.md5("answer").alias("a")
    )


@register("p03_first_k_per_entity", _QL + "SELECT entity, turn, md5(question) AS q FROM qa_lists QUALIFY row_number() OVER (PARTITION BY entity ORDER BY turn) <= 2")
def p03(t: Tables):
    return P.first_k_per_entity(t.qa_lists(), 2, ["turn"]).select("entity", "turn", F.md5("question").alias("q"))


@register("p04_spread_k_per_entity", """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
 count(*) OVER (PARTITION BY source) AS n FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')
WHERE n <= 7 OR pos IN (0, (n - 1) // 6, 2 * (n - 1) // 6, 3 * (n - 1) // 6, 4 * (n - 1) // 6, 5 * (n - 1) // 6, n - 1)""")
def p04(t: Tables):
    docs = t.documents().select("source", "doc_id", F.col("text").alias("question"), F.col("lang").alias("answer"))
    return P.spread_k_per_entity(docs, 7, ["doc_id"], "source").select("source", "doc_id")


@register("p05_identity_balanced", _QL + f"""SELECT entity, turn, md5(question) AS q FROM qa_lists
QUALIFY row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN contains({S.norm_terms('question')}, 'name') THEN 0 ELSE 1 END, turn) = 1""")
def p05(t: Tables):
    return P.identity_balanced(t.qa_lists(), 1, ["turn"]).select("entity", "turn", F.md5("question").alias("q"))


@register("p05_identity_balanced_spread", _QL + """SELECT entity, turn FROM (SELECT entity, turn, row_number() OVER (PARTITION BY entity ORDER BY turn) - 1 AS pos,
 count(*) OVER (PARTITION BY entity) AS n FROM qa_lists) WHERE n <= 2 OR pos IN (0, n - 1)""")
def p05_spread(t: Tables):
    return P.identity_balanced(t.qa_lists(), 2, ["turn"]).select("entity", "turn")


def identities(t: Tables):
    """Nested records: the sentences of a document, taken as question-answer pairs."""

    def pairs(s):
        at = lambda i: F.coalesce(F.get(s, i), F.lit(""))
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(2)), F.lit(2)),
            lambda i: F.struct(
                F.when((i + F.col("doc_id")) % 5 == 0, F.concat(F.lit("Who is "), F.get(s, i - 1)))
                .otherwise(F.get(s, i - 1)).alias("question"),
                at(i).alias("answer"),
                F.array(at(i), F.lit(" ")).alias("keywords"),
            ),
        )

    return t.documents().select(
        F.col("doc_id").alias("entity"), let(F.split("text", r"\."), pairs).alias("qa_list")
    )


IDENTITIES = """identities AS (SELECT doc_id AS entity, list_transform(range(1, greatest(len(s), 2) + 1, 2), lambda i: {
  'question': CASE WHEN (i + doc_id) % 5 = 0 THEN 'Who is ' || s[i] ELSE s[i] END, 'answer': coalesce(s[i + 1], ''), 'kw': coalesce(s[i + 1], ''), 'i': i}) AS qa_list
  FROM (SELECT doc_id, string_split(text, '.') AS s FROM documents)),
qa_rows AS (SELECT entity, unnest(qa_list, recursive := true) FROM identities)"""


@register("p06_name_question_subset", with_(IDENTITIES) + f"""SELECT entity, md5(question) AS q, md5(answer) AS a FROM qa_rows
QUALIFY row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN {' OR '.join(f"contains({S.norm_name('question')}, '{p}')" for p in V.NAME_QUESTION_PHRASES)} THEN 0 ELSE 1 END, i) = 1""")
def p06(t: Tables):
    return P.name_question_subset(identities(t)).select("entity", F.md5("question").alias("q"), F.md5("answer").alias("a"))


@register("p07_explode_qas", with_(IDENTITIES) + f"""SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY i) - 1 AS qa_index, md5(trim(question)) AS q, md5(trim(answer)) AS a,
CASE WHEN trim(kw) <> '' THEN 1 ELSE 0 END AS n_keywords FROM qa_rows WHERE {S.sq('question')} <> '' AND {S.sq('answer')} <> ''""")
def p07(t: Tables):
    return P.explode_qas(identities(t)).select(
        "entity", "qa_index", F.md5("question").alias("q"), F.md5("answer").alias("a"),
        F.size("keywords").alias("n_keywords"),
    )


def samples(t: Tables):
    s = t.documents().select("doc_id", F.split("text", r"\.").alias("s"))
    part = lambda i: F.coalesce(F.get("s", F.lit(i)), F.lit(""))
    return s.select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 400).alias("image_id"),
        part(0).alias("src"), part(1).alias("pred"),
        F.transform(F.slice("s", F.lit(2), F.size("s")), lambda x: F.concat(F.lit("nq question: "), x)).alias("rephrase"),
        F.when(F.col("doc_id") % 4 != 0, F.slice("s", F.lit(2), F.size("s"))).alias("loc"),
        F.slice("s", F.lit(3), F.size("s")).alias("loc_ans"),
    )


SAMPLES = """samples AS (SELECT doc_id AS id, doc_id % 400 AS image_id, coalesce(s[1], '') AS src, coalesce(s[2], '') AS pred, s[2:] AS rephrase,
  CASE WHEN doc_id % 4 <> 0 THEN s[2:] END AS loc, s[3:] AS loc_ans FROM (SELECT doc_id, string_split(text, '.') AS s FROM documents)),
valid AS (SELECT s.*, p.url AS path FROM samples s JOIN pages p ON p.page_id = s.image_id)"""


@register("p08_build_forget_retain", with_(SAMPLES) + """SELECT split, entity, image, md5(q) AS q, md5(a) AS a, n_rephrases, sample_id FROM (
SELECT 'forget' AS split, 'unlok_' || CAST(id AS VARCHAR) AS entity, path AS image, trim(src) AS q, trim(pred) AS a,
  len(list_filter(rephrase[1:5], lambda x: trim(x) <> '')) AS n_rephrases, id AS sample_id FROM valid
UNION ALL SELECT 'retain', 'loc_' || CAST(id AS VARCHAR), path, trim(z.q), trim(z.a), 0, id FROM (SELECT id, path, unnest(list_transform(range(1, least(len(loc), len(loc_ans)) + 1),
  lambda i: {'q': loc[i], 'a': loc_ans[i]})) AS z FROM valid WHERE loc IS NOT NULL) WHERE trim(z.q) <> '' AND trim(z.a) <> '')""")
def p08(t: Tables):
    files = t.table("pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("path"))
    return P.build_forget_retain(samples(t), files).select(
        "split", "entity", "image", F.md5("question").alias("q"), F.md5("answer").alias("a"),
        F.size("rephrases").alias("n_rephrases"), "sample_id",
    )


@register("p09_item_ids", with_(ITEMS) + """SELECT split, entity, turn, CAST(entity AS VARCHAR) || '_' || CASE WHEN pos < 1000 THEN lpad(CAST(pos AS VARCHAR), 3, '0') ELSE CAST(pos AS VARCHAR) END AS item_id
FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY entity, turn) - 1 AS pos FROM items)""")
def p09(t: Tables):
    return P.item_ids(items(t), ["entity", "turn"], ["split"]).select("split", "entity", "turn", "item_id")


URL_ID = r"/(\d+)"
_LANG = "CASE WHEN contains(url, '/en/') THEN 0 WHEN contains(url, '/fr/') THEN 1 ELSE 2 END"
INDEX = f"""file_index AS (SELECT CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS file_id, url AS path FROM pages WHERE regexp_matches(url, '/[0-9]+')
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY {_LANG}, url) = 1)"""


def url_index(t: Tables):
    path = F.col("path")
    lang = F.when(F.contains(path, F.lit("/en/")), 0).when(F.contains(path, F.lit("/fr/")), 1)
    lang = lang.otherwise(2)
    return index_files(t.files(), URL_ID, lang)


@register("s11_index_files", with_(INDEX) + "SELECT file_id, path FROM file_index")
def s11(t: Tables):
    return url_index(t)


@register("g12_id_coverage", with_(INDEX) + f"""SELECT count(*) AS n_needed, count(f.file_id) AS n_found, {r("100.0 * count(f.file_id) / count(*)")} AS pct
FROM (SELECT DISTINCT doc_id % 997 AS file_id FROM documents) n LEFT JOIN file_index f USING (file_id)""")
def g12(t: Tables):
    return G.id_coverage(t.documents().select((F.col("doc_id") % 997).alias("file_id")), url_index(t), "file_id")


_KEYS = "[CASE WHEN doc_id % 3 = 0 THEN 'Page_' || CAST(doc_id AS VARCHAR) || '.jpg' END, CASE WHEN doc_id % 5 = 0 THEN 'PAGE_' || CAST(doc_id AS VARCHAR) END, 'sfhq_pt1_' || CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR)]"
RESOLVE = f"""keyed AS (SELECT DISTINCT ON (k) k, path FROM (SELECT 'img/' || CASE WHEN page_id % 2 = 0 THEN 'page_' ELSE 'sfhq_pt1_' END || CAST(page_id AS VARCHAR) || '.JPG' AS path,
   unnest([lower(split_part(path, '/', 2)), regexp_replace(lower(split_part(path, '/', 2)), '[.][^.]*$', '')]) AS k FROM pages) ORDER BY k, path),
cand AS (SELECT doc_id, i, lower(({_KEYS})[i]) AS k FROM documents, (SELECT unnest([1, 2, 3, 4]) AS i))"""


def _resolve(t: Tables, how: str):
    page = F.col("page_id").cast("string")
    paths = t.table("pages").select(
        F.concat(F.lit("img/"), F.when(F.col("page_id") % 2 == 0, "page_").otherwise("sfhq_pt1_"), page, F.lit(".JPG")).alias("path")
    )
    doc = F.col("doc_id").cast("string")
    keys = [
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Page_"), doc, F.lit(".jpg"))),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("PAGE_"), doc)),
        F.concat(F.lit("sfhq_pt1_"), doc), doc,
    ]
    return J.resolve_files(t.documents().select("doc_id"), J.file_key_index(paths), "doc_id", keys, how)


@register("j02_resolve_files", with_(RESOLVE) + "SELECT doc_id, path FROM cand JOIN keyed USING (k) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i, path) = 1")
def j02(t: Tables):
    return _resolve(t, "inner").select("doc_id", "path")


@register("j02_unresolved_files", with_(RESOLVE) + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM cand JOIN keyed USING (k))")
def j02_missing(t: Tables):
    return _resolve(t, "left_anti").select("doc_id")


@register("j06_mismatched_control", with_(ITEMS, """nxt AS (SELECT image, coalesce(lead(image) OVER (ORDER BY md5('42|' || image), image),
  first(image) OVER (ORDER BY md5('42|' || image), image)) AS other FROM (SELECT DISTINCT image FROM items))""") + """
SELECT entity, turn, m.mode, CASE m.mode WHEN 'correct' THEN image WHEN 'mismatched' THEN CASE WHEN other <> image THEN other END END AS used_value
FROM items JOIN nxt USING (image), (SELECT unnest(['correct', 'mismatched', 'blank']) AS mode) m""")
def j06(t: Tables):
    return J.mismatched_control(items(t), "image", 42).select("entity", "turn", "mode", "used_value")


@register("g08_split_quality", with_(ITEMS) + """SELECT split, count(*) AS n, count(*) FILTER (WHERE image NOT IN (SELECT path FROM files)) AS missing_image,
count(*) FILTER (WHERE coalesce(question, '') = '') AS missing_question, count(*) FILTER (WHERE coalesce(answer, '') = '') AS missing_answer,
count(*) > 0 AND bool_and(image IN (SELECT path FROM files) AND coalesce(question, '') <> '' AND coalesce(answer, '') <> '') AS ok FROM items GROUP BY split""")
def g08(t: Tables):
    return G.split_quality(items(t), image_files(t))


def _prep(t: Tables):
    """Conversations as identities: an image when its page exists, questions when it has pairs."""
    convs = t.table("conversations").select(F.col("conv_id").alias("entity")).distinct()
    images = image_files(t).withColumn("has_image", F.lit(True))
    qa = t.qa_lists().select("entity").distinct().withColumn("has_qa", F.lit(True))
    return (
        convs.withColumn("path", F.concat(F.lit("img/"), (F.col("entity") % 120).cast("string")))
        .join(images, "path", "left").join(qa, "entity", "left")
        .select("entity", F.coalesce("has_image", F.lit(False)).alias("has_image"), F.coalesce("has_qa", F.lit(False)).alias("has_qa"))
    )


_PREP = ITEMS + """, ident AS (SELECT entity, 'img/' || CAST(entity % 120 AS VARCHAR) IN (SELECT path FROM files) AS has_image,
  entity IN (SELECT entity FROM qa_lists) AS has_qa FROM (SELECT DISTINCT conv_id AS entity FROM conversations))"""


@register("g09_preparation_report", with_(_PREP) + """SELECT count(*) AS source_records, count(*) FILTER (WHERE NOT has_image) AS n_no_image,
count(*) FILTER (WHERE has_image AND NOT has_qa) AS n_no_qa, (SELECT count(*) FROM qa_lists) AS items, (SELECT count(DISTINCT entity) FROM qa_lists) AS identities,
CASE WHEN bool_and(has_image) AND count(*) = 100 THEN 'PASS' ELSE 'FAIL' END AS gate FROM ident""")
def g09(t: Tables):
    return G.preparation_report(_prep(t), t.qa_lists(), {"source_records": 100})


@register("g09_identities_lacking", with_(_PREP) + "SELECT entity, CASE WHEN NOT has_image THEN 'no_image' ELSE 'no_qa' END AS reason FROM ident WHERE NOT has_image OR NOT has_qa")
def g09_lacking(t: Tables):
    return G.identities_lacking(_prep(t))
