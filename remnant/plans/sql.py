"""Building blocks of the reference SQL (DuckDB dialect) used to check the queries."""

from __future__ import annotations

WS = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def r(x: str) -> str:
    """Report form of a double."""
    return f"(round(round(CAST({x} AS DOUBLE), 9), 6) + 0.0)"


def sq(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({sq(x)}, ' '), lambda w: w <> '')"


def casefold(x: str) -> str:
    return f"replace(lower(coalesce({x}, '')), 'ß', 'ss')"


def norm_compact(x: str) -> str:
    return f"regexp_replace(strip_accents(lower({clean(x)})), '[^a-z0-9]+', '', 'g')"


def norm_words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(strip_accents(lower({clean(x)})), '[a-z0-9]+'))"


def clean(x: str) -> str:
    out = f"coalesce({x}, '')"
    for marker in (" ' || chr(129) || '", "<s>", "</s>", "<pad>", "<unk>"):
        out = f"replace({out}, '{marker}', ' ')"
    return f"trim(regexp_replace({out}, '{WS}', ' ', 'g'))"


def norm_answer(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"


def norm_terms(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({casefold(x)}, '[^a-z0-9$+.\\- ]+', ' ', 'g'), ' +', ' ', 'g'))"


def norm_name(x: str) -> str:
    return f"trim(regexp_replace({casefold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def norm_token(x: str) -> str:
    return f"trim(regexp_replace({casefold(x)}, '[^a-z0-9]+', '_', 'g'), '_')"


PREDICTIONS = """predictions AS (
  SELECT event_id, ts, run, split, entity, CAST(k AS VARCHAR) AS question,
         'a' || CAST(k % 7 AS VARCHAR) AS answer, entity || '::' || CAST(k AS VARCHAR) AS item_key,
         value > 30 AS correct, value < 5 AS refusal, value < 2 AS collapsed,
         CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS response,
         ['direct', 'rephrase', 'crop', 'perturb'][CAST(k % 4 AS INTEGER) + 1] AS attack,
         ['correct', 'mismatched', 'blank'][CAST(k % 3 AS INTEGER) + 1] AS mode,
         CASE WHEN value > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM (SELECT *, event_type AS run, CASE WHEN user_id % 3 = 0 THEN 'forget' ELSE 'retain' END AS split,
               CAST(user_id AS VARCHAR) AS entity, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
        FROM events))"""

LAST = """last_pred AS (
  SELECT * FROM predictions
  QUALIFY row_number() OVER (PARTITION BY run, split, item_key ORDER BY ts DESC, event_id DESC) = 1)"""

ALIGNED = """aligned AS (
  SELECT m.run, m.split, m.item_key, m.entity, b.correct AS base_correct, m.correct AS method_correct,
         b.response AS base_response, m.response AS method_response
  FROM last_pred m JOIN last_pred b ON b.run = 'signup' AND m.run <> 'signup'
   AND m.split = b.split AND m.item_key = b.item_key)"""

BEHAVIOUR = """behaviour AS (
  SELECT run, avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE split = 'forget') AS forget_acc,
         avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE split = 'retain') AS retain_acc,
         count(*) FILTER (WHERE split = 'forget') AS forget_n, count(*) FILTER (WHERE split = 'retain') AS retain_n
  FROM predictions GROUP BY run)"""

DELTAS = """deltas AS (
  SELECT a.run, a.forget_acc, a.retain_acc, a.forget_acc - b.forget_acc AS delta_forget,
         a.retain_acc - b.retain_acc AS delta_retain
  FROM behaviour a JOIN behaviour b ON b.run = 'signup')"""

QA_RESPONSES = f"""qa AS (
  SELECT d.doc_id, d.text AS response, p.p_name AS entity, array_to_string(prev, ' ') AS answer,
         list_filter([prev[2], prev[5]], lambda x: x IS NOT NULL) AS keywords,
         list_distinct([p.p_name, lower(p.p_name), string_split(p.p_name, ' ')[1], string_split(p.p_name, ' ')[-1]]) AS aliases
  FROM (SELECT *, lag(({words('text')})[1:6]) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents) d
  JOIN part p ON p.p_partkey = d.doc_id % (SELECT count(*) FROM part))"""

ACTIVATIONS = """act AS (
  SELECT run, component, layer, vec_id AS item_id, label AS entity,
         CASE WHEN label % 3 = 0 THEN 'forget' ELSE 'retain' END AS split,
         list_transform(range(1, 9), lambda u: CAST(embedding[21 * ci + 7 * layer + u] AS DOUBLE)
           + run * 0.02::DOUBLE * (((vec_id * 31 + (21 * ci + 7 * layer + u) * 17) % 11) - 5)) AS vec
  FROM embeddings, (SELECT unnest([0, 1, 2, 3, 4]) AS run),
       (SELECT unnest([0, 1, 2]) AS ci), (SELECT unnest([0, 1, 2]) AS layer),
       (SELECT ['ve', 'br', 'lb'] AS names), LATERAL (SELECT names[ci + 1] AS component))"""

PAIRS = """pairs AS (
  SELECT y.run, y.component, y.layer, y.item_id, y.entity, y.split, x.vec AS x, y.vec AS y
  FROM act y JOIN act x USING (component, layer, item_id) WHERE x.run = 0 AND y.run <> 0)"""

TOKENS = """tokens AS (
  SELECT l_linestatus AS run, l_orderkey AS item_id, -l_extendedprice / 10000 AS logprob,
         l_returnflag <> 'N' AS supervised, l_quantity AS rank,
         row_number() OVER (PARTITION BY l_linestatus, l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos
  FROM lineitem)"""

PROBES = f"""probes AS (
  SELECT d.source AS entity, d.lang AS relation, d.doc_id AS neighbor, d.text AS response, n.forget_name,
         array_to_string(({words('d.text')})[1:2], ' ') AS label
  FROM documents d JOIN (SELECT source, array_to_string(({words('text')})[1:3], ' ') AS forget_name FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1) n USING (source))"""

RESULTS = """results_long AS (
  SELECT o_orderkey AS row_id,
         CASE o_orderstatus WHEN 'P' THEN 'mllmu_real' WHEN 'O' THEN 'mllmu_bench' ELSE 'unlok_vqa' END AS dataset,
         o_orderpriority AS method, o_custkey % 5 AS seed, CAST(o_custkey % 50 AS VARCHAR) AS source_file,
         o_totalprice / 500000 AS forget_accuracy,
         CASE WHEN o_orderkey % 7 <> 0 THEN 1 - o_totalprice / 500000 END AS retain_accuracy,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 500000 / 2 END AS cnis
  FROM orders)"""

QA_LISTS = """qa_lists AS (
  SELECT u.conv_id AS entity, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def p_value(corr: str, n: str) -> str:
    """Two-sided p value of a correlation: the t distribution of whole degrees as a finite sum."""
    even = "exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi())"
    odd = "exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2"
    total = "coalesce(list_sum(list_transform(range(0, {top}), lambda k: {c} * pow(1 - {r} * {r}, k))), 0)"
    c, df = f"({corr})", f"CAST({n} - 2 AS BIGINT)"
    a_even = f"abs({c}) * " + total.format(top=f"{df} // 2", c=even, r=c)
    a_odd = f"2 / pi() * (asin(least(1.0, abs({c}))) + abs({c}) * sqrt(greatest(0.0, 1 - {c} * {c})) * " + total.format(top=f"({df} - 1) // 2", c=odd, r=c) + ")"
    return f"CASE WHEN {df} > 0 AND {c} IS NOT NULL THEN greatest(0.0, 1 - CASE WHEN {df} % 2 = 0 THEN {a_even} ELSE {a_odd} END) END"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
