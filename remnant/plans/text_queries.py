"""Queries for the text functions and response scorers, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from remnant.functions import fixed_values as V
from remnant.functions import scorers as R
from remnant.functions import text as T
from remnant.plans import sql as S
from remnant.plans.registry import register
from remnant.plans.sql import r, with_
from remnant.plans.views import Tables

_QA = with_(S.QA_RESPONSES)


def _normalizer(name: str, fn, sql: str):
    """Length and digest of the normalized text of each document."""

    @register(name, f"SELECT doc_id, length(v) AS n, md5(v) AS digest FROM (SELECT doc_id, {sql} AS v FROM documents)")
    def query(t: Tables):
        v = fn(F.concat(F.lit("<s> The **a: "), F.col("text"), F.lit(" ASSISTANT:  end </s>")))
        return t.documents().select("doc_id", v.alias("v")).select(
            "doc_id", F.length("v").alias("n"), F.md5("v").alias("digest")
        )


_TXT = "('<s> The **a: ' || text || ' ASSISTANT:  end </s>')"


def nfkd_sql(x: str) -> str:
    out = f"lower({S.sq(x)})"
    for letters, plain in (("éèê", "e "), ("óö", "o "), ("ñ", "n "), ("ü", "u "), ("ç", "c "), ("ä", "a "), ("í", "i ")):
        out = f"regexp_replace({out}, '[{letters}]', '{plain}', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_normalizer("t01_clean_generated", T.clean_generated, S.clean(_TXT))
_normalizer("t02_norm_compact", T.norm_compact, S.norm_compact(_TXT))
_normalizer("t03_norm_words", lambda c: F.array_join(F.array_sort(T.norm_words(c)), " "),
            f"array_to_string(list_sort({S.norm_words(_TXT)}), ' ')")
_normalizer("t04_norm_token", T.norm_token, S.norm_token(_TXT))
_normalizer("t05_norm_answer", T.norm_answer, S.norm_answer(_TXT))
_normalizer("t06_norm_terms", T.norm_terms, S.norm_terms(_TXT))
_normalizer("t07_norm_name", T.norm_name, S.norm_name(_TXT))
_normalizer("t08_norm_unicode", T.norm_unicode, nfkd_sql(_TXT))
_normalizer("t09_clean_answer", lambda c: T.clean_answer(T.clean_generated(c)),
            f"trim(replace(regexp_replace(regexp_replace({S.clean(_TXT)}, '^\\s*the\\s+', '', 'i'), '^\\s*\\*{{0,2}}\\s*a\\s*:\\s*', '', 'i'), '**', ''))")
_normalizer("t10_squash_ws", T.squash_ws, S.sq(_TXT))
_normalizer("t15_assistant_tail", T.assistant_tail, f"trim(string_split({_TXT}, 'ASSISTANT:')[-1])")

#: Names are whole fields; words are cut at any white space.
_NAME = "trim(text)"


def _alias_sql(n: str) -> str:
    parts = [n, f"CASE WHEN len({S.words(n)}) > 1 THEN ({S.words(n)})[1] END", f"CASE WHEN len({S.words(n)}) > 1 THEN ({S.words(n)})[-1] END", f"strip_accents({n})"]
    both = [v for p in parts for v in (p, f"lower({p})")]
    return f"list_sort(list_distinct(list_filter([{', '.join(both)}], lambda a: a IS NOT NULL AND a <> '')))"


@register("t11_build_aliases", f"SELECT item_id, array_to_string({_alias_sql('name')}, '|') AS aliases FROM (SELECT item_id, {_NAME} AS name FROM benchmark)")
def t11(t: Tables):
    return t.table("benchmark").select("item_id", F.array_join(F.array_sort(T.build_aliases("text")), "|").alias("aliases"))


#: A name inside the text: were the whole text its own name, every question would be the same.
_NAME2 = f"array_to_string(({S.words('text')})[1:2], ' ')"


def _name2():
    return F.array_join(F.slice(T.split_words("text"), 1, 2), " ")


@register("t12_rephrase_question", f"""SELECT conv_id, turn, CASE WHEN q = '' THEN '{V.DEFAULT_REPHRASED_QUESTION}' ELSE q END AS question FROM (
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(list_reduce(list_prepend('Who is this? ' || text, list_sort_len), lambda acc, a:
  CASE WHEN instr(lower(acc), lower(a)) > 0 THEN substr(acc, 1, instr(lower(acc), lower(a)) - 1) || 'this person' || substr(acc, instr(lower(acc), lower(a)) + length(a)) ELSE acc END),
  '\\bwho is\\b', 'describe', 'gi'), '\\bwhat is the name of\\b', 'identify', 'gi')) AS q
FROM (SELECT conv_id, turn, text, list_transform(list_sort(list_transform(al, lambda a: lpad(CAST(1000000 - length(a) AS VARCHAR), 8, '0') || a)), lambda s: substr(s, 9)) AS list_sort_len
  FROM (SELECT conv_id, turn, text, {_alias_sql('name')} AS al FROM (SELECT *, {_NAME2} AS name FROM conversations))))""")
def t12(t: Tables):
    question = F.concat(F.lit("Who is this? "), F.col("text"))
    return t.table("conversations").select(
        "conv_id", "turn", T.rephrase_question(question, T.build_aliases(_name2())).alias("question")
    )


_TPL = ", ".join(f"({i}, '{q}')" for i, q in enumerate(V.REPHRASE_TEMPLATES))


@register("t13_rephrase_templates", f"SELECT entity, i AS template_index, replace(q, '{{}}', entity) AS question FROM (SELECT DISTINCT p_name AS entity FROM part), (VALUES {_TPL}) v(i, q)")
def t13(t: Tables):
    return T.rephrase_templates(t.table("part").select(F.col("p_name").alias("entity")).distinct(), n=len(V.REPHRASE_TEMPLATES))


RELATIONS = [*V.PROBE_TEMPLATES, "P999"]


def edges(t: Tables):
    rel = F.get(F.array(*[F.lit(x) for x in RELATIONS]), (F.col("doc_id") % len(RELATIONS)).cast("int"))
    return t.documents().select(
        F.col("source").alias("entity"), rel.alias("relation"), F.col("doc_id").cast("string").alias("neighbor")
    )


_PT = ", ".join(
    f"('{rel}', {i}, '{q.replace(chr(39), chr(39) * 2)}')"
    for rel in RELATIONS
    for i, q in enumerate(V.PROBE_TEMPLATES.get(rel, V.DEFAULT_PROBES)[: V.PROBES_PER_RELATION])
)
EDGES = f"""edges AS (SELECT source AS entity, [{', '.join(f"'{x}'" for x in RELATIONS)}][CAST(doc_id % {len(RELATIONS)} AS INTEGER) + 1] AS relation,
  CAST(doc_id AS VARCHAR) AS neighbor FROM documents), templates(relation, i, q) AS (VALUES {_PT})"""


@register("t14_probe_questions", with_(EDGES) + "SELECT entity, relation, neighbor, i AS template_index, replace(q, '{neighbor}', neighbor) AS probe_q FROM edges JOIN templates USING (relation)")
def t14(t: Tables):
    return T.probe_questions(edges(t))


@register("t16_word_count", f"SELECT doc_id, len({S.words('text')}) AS n FROM documents")
def t16(t: Tables):
    return t.documents().select("doc_id", T.word_count("text").alias("n"))


_NUMS_SQL = """CASE o_orderkey % 7 WHEN 0 THEN CAST(o_custkey AS VARCHAR) || '%' WHEN 1 THEN ' ' || CAST(o_custkey AS VARCHAR) || '.5 ' WHEN 2 THEN 'nan'
 WHEN 3 THEN 'true' WHEN 4 THEN 'n/a' WHEN 5 THEN '-' || CAST(o_custkey AS VARCHAR) || 'e-2' ELSE NULL END"""


@register("t17_parse_number", f"""SELECT o_orderkey, CASE WHEN regexp_full_match(trim(replace(raw, '%', '')), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
 THEN {r("try_cast(trim(replace(raw, '%', '')) AS DOUBLE) / CASE WHEN raw LIKE '%\\%%' ESCAPE '\\' THEN 100 ELSE 1 END")} END AS value FROM (SELECT o_orderkey, {_NUMS_SQL} AS raw FROM orders)""")
def t17(t: Tables):
    k, c = F.col("o_orderkey") % 7, F.col("o_custkey").cast("string")
    raw = (
        F.when(k == 0, F.concat(c, F.lit("%"))).when(k == 1, F.concat(F.lit(" "), c, F.lit(".5 ")))
        .when(k == 2, "nan").when(k == 3, "true").when(k == 4, "n/a")
        .when(k == 5, F.concat(F.lit("-"), c, F.lit("e-2")))
    )
    return t.table("orders").select("o_orderkey", T.parse_number(raw).alias("value"))


_ALL_DATASET = [a for al in V.DATASET_ALIASES.values() for a in al] + ["other"]
_ALL_METHOD = [a for al in V.METHOD_ALIASES.values() for a in al] + ["other", "gadget"]


def _path():
    d, m = (F.array(*[F.lit(x) for x in xs]) for xs in (_ALL_DATASET, _ALL_METHOD))
    k = F.col("o_orderkey")
    return F.concat(
        F.lit("/Runs/"), F.get(d, (k % len(_ALL_DATASET)).cast("int")), F.lit("/"),
        F.upper(F.get(m, (k % len(_ALL_METHOD)).cast("int"))), F.lit("-Seed_"), (F.col("o_custkey") % 9).cast("string"), F.lit("/r.json"),
    )


_PATH = f"""'/Runs/' || [{', '.join(f"'{x}'" for x in _ALL_DATASET)}][CAST(o_orderkey % {len(_ALL_DATASET)} AS INTEGER) + 1] || '/' ||
 upper([{', '.join(f"'{x}'" for x in _ALL_METHOD)}][CAST(o_orderkey % {len(_ALL_METHOD)} AS INTEGER) + 1]) || '-Seed_' || CAST(o_custkey % 9 AS VARCHAR) || '/r.json'"""
_PATHS = f"paths AS (SELECT o_orderkey, {_PATH} AS path FROM orders)"
_DS_CASE = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(lower(path), {chr(39)}{a}{chr(39)})' for a in al)} THEN '{d}'" for d, al in V.DATASET_ALIASES.items()
) + " END"
_M_CASE = "CASE " + " ".join(
    f"WHEN contains('_' || {S.norm_token('path')} || '_', '_{n}_') THEN '{m}'"
    for _, m, n in sorted(((len(a), m, a.replace("-", "_")) for m, al in V.METHOD_ALIASES.items() for a in al), reverse=True)
) + " END"


@register("t18_canonical_dataset", with_(_PATHS) + f"SELECT o_orderkey, {_DS_CASE} AS dataset FROM paths")
def t18(t: Tables):
    return t.table("orders").select("o_orderkey", T.canonical_dataset(_path()).alias("dataset"))


@register("t19_canonical_method", with_(_PATHS) + f"SELECT o_orderkey, {_M_CASE} AS method FROM paths")
def t19(t: Tables):
    return t.table("orders").select("o_orderkey", T.canonical_method(_path()).alias("method"))


@register("t20_infer_seed", with_(_PATHS) + """SELECT o_orderkey, coalesce(try_cast(leaf AS BIGINT), try_cast(nullif(regexp_extract(path, '(?i)(?:seed|s)[_\\-]?(\\d{1,6})', 1), '') AS BIGINT)) AS seed
FROM (SELECT o_orderkey, path, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 5 AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN 'x' END AS leaf FROM paths)""")
def t20(t: Tables):
    k = F.col("o_orderkey")
    leaf = F.when(k % 3 == 0, (k % 5).cast("string")).when(k % 3 == 1, "x")
    return t.table("orders").select("o_orderkey", T.infer_seed(_path(), leaf).alias("seed"))


_PM = "CASE " + " ".join(f"WHEN contains(lower(path), '{m}') THEN '{m}'" for m in V.PATH_METHODS) + " ELSE 'unknown' END"


@register("t21_method_from_path", with_(_PATHS) + f"SELECT o_orderkey, {_PM} AS method FROM paths")
def t21(t: Tables):
    return t.table("orders").select("o_orderkey", T.method_from_path(_path()).alias("method"))


# -- scorers ---------------------------------------------------------------------------
def _score(name: str, column, sql: str, kind: str = "correct"):
    @register(name, _QA + f"SELECT doc_id, {sql} AS {kind} FROM qa")
    def query(t: Tables):
        return t.qa_responses().select("doc_id", column().alias(kind))


@register("r01_entity_or_answer", _QA[:-1] + f""", n AS MATERIALIZED (SELECT doc_id, answer, {S.norm_compact('response')} AS rc, {S.norm_words('response')} AS rw FROM qa),
names AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_append(aliases, entity)) AS a FROM qa),
cand AS MATERIALIZED (SELECT a, {S.norm_compact('a')} AS ac, {S.norm_words('a')} AS aw FROM (SELECT a FROM names UNION SELECT answer FROM qa)),
hits AS (SELECT doc_id, bool_or((ac <> '' AND contains(rc, ac)) OR (len(aw) > 0 AND list_has_all(rw, aw))) AS named FROM names JOIN cand USING (a) JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, named OR (coalesce(answer, '') <> '' AND ((ac <> '' AND contains(rc, ac)) OR (len(aw) BETWEEN 1 AND 5 AND list_has_all(rw, aw))
 OR (len(aw) > 5 AND len(list_filter(aw, lambda w: list_contains(rw, w))) >= 2))) AS correct FROM n JOIN hits USING (doc_id) JOIN cand ON cand.a IS NOT DISTINCT FROM n.answer""")
def r01(t: Tables):
    return t.qa_responses().select("doc_id", R.entity_or_answer("response", "entity", "aliases", "answer").alias("correct"))


_score("r02_refusal", lambda: R.refusal("response"),
       " OR ".join(f"contains(lower({S.clean('response')}), '{p.replace(chr(39), chr(39) * 2)}')" for p in V.REFUSAL_PHRASES), "refusal")
_score("r03_answer_or_alias_normalized", lambda: R.answer_or_alias_normalized("response", "answer", "aliases"),
       f"len(list_filter(list_prepend(coalesce(answer, ''), aliases), lambda c: {S.norm_answer('c')} <> '' AND contains({S.norm_answer('response')}, {S.norm_answer('c')}))) > 0")
_score("r04_answer_or_alias_raw", lambda: R.answer_or_alias_raw("response", "answer", "aliases"),
       "len(list_filter(list_prepend(coalesce(answer, ''), aliases), lambda c: trim(lower(c)) <> '' AND contains(lower(response), trim(lower(c))))) > 0")
_score("r05_answer_raw", lambda: R.answer_raw("response", "answer"),
       "coalesce(answer, '') <> '' AND contains(lower(response), lower(coalesce(answer, '')))")
_score("r06_keyword_terms", lambda: R.keyword_match("response", "keywords", "entity", "answer"),
       f"len(list_filter(list_concat(coalesce(keywords, []), [entity, coalesce(answer, '')]), lambda c: length({S.norm_terms('c')}) >= 2 AND contains({S.norm_terms('response')}, {S.norm_terms('c')}))) > 0")
_score("r07_exact_name", lambda: R.exact_name("response", "entity"),
       f"{S.norm_name('entity')} <> '' AND contains({S.norm_name('response')}, {S.norm_name('entity')})")
_score("r08_recovery_score", lambda: R.recovery_score("response", "entity", "answer"),
       "CAST((CASE WHEN contains(lower(response), lower(entity)) THEN 0.5 ELSE 0 END) + (CASE WHEN len(list_filter(list_filter(regexp_split_to_array(lower(coalesce(answer, '')), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) > 3)[1:3], lambda w: contains(lower(response), w))) > 0 THEN 0.5 ELSE 0 END) AS DOUBLE)", "score")


@register("r12_generation_collapse", f"""SELECT doc_id, {r("u::DOUBLE / greatest(n, 1)")} AS unique_ratio, n > 4 AND u::DOUBLE / greatest(n, 1) < 0.3 AS collapsed
FROM (SELECT doc_id, len({S.words('text')}) AS n, len(list_distinct({S.words('text')})) AS u FROM documents)""")
def r12(t: Tables):
    return t.documents().select(
        "doc_id", R.unique_token_ratio(T.split_words("text")).alias("unique_ratio"), R.generation_collapse("text").alias("collapsed")
    )


@register("r12_collapse_by_source", f"""SELECT source, {r("avg(CASE WHEN n > 4 AND u::DOUBLE / greatest(n, 1) < 0.3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS collapse_fraction
FROM (SELECT source, len({S.words('text')}) AS n, len(list_distinct({S.words('text')})) AS u FROM documents) GROUP BY source""")
def r12_runs(t: Tables):
    return t.documents().groupBy("source").agg(F.avg(R.generation_collapse("text").cast("double")).alias("collapse_fraction"))


_score("r13_suppressed_output", lambda: R.suppressed_output("response"),
       "(" + " OR ".join(f"contains(lower({S.clean('response')}), '{p.replace(chr(39), chr(39) * 2)}')" for p in V.REFUSAL_PHRASES) + f") OR {S.norm_compact('response')} = ''", "suppressed")
