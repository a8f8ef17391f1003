"""Queries over token likelihoods, neighbourhood probes and corpus containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from remnant.functions import scorers as R
from remnant.functions import text as T
from remnant.operators import alignment as J
from remnant.operators import likelihood as L
from remnant.operators import neighborhood as N
from remnant.plans import sql as S
from remnant.plans.registry import register
from remnant.plans.sql import r, with_
from remnant.plans.text_queries import EDGES, edges, nfkd_sql
from remnant.plans.views import Tables

_T = with_(S.TOKENS)
ITEM_LP = """item_lp AS (SELECT run, item_id, count(*) FILTER (WHERE supervised) AS n_tokens,
  coalesce(sum(logprob) FILTER (WHERE supervised), 0) / (count(*) FILTER (WHERE supervised) + 1e-8::DOUBLE) AS mean_logprob,
  -avg(logprob) FILTER (WHERE supervised) AS nll FROM tokens GROUP BY run, item_id)"""


@register("l01_item_mean_logprob", with_(S.TOKENS, ITEM_LP) + f"SELECT run, item_id, n_tokens, {r('mean_logprob')} AS mean_logprob FROM item_lp")
def l01(t: Tables):
    return L.item_likelihood(t.token_logprobs()).select("run", "item_id", "n_tokens", "mean_logprob")


@register("l02_item_nll", with_(S.TOKENS, ITEM_LP) + f"SELECT run, item_id, {r('nll')} AS nll FROM item_lp")
def l02(t: Tables):
    return L.item_likelihood(t.token_logprobs()).select("run", "item_id", "nll")


@register("l03_likelihood_summary", with_(S.TOKENS, ITEM_LP, """firsts AS (SELECT run, item_id, rank FROM tokens WHERE supervised
  QUALIFY row_number() OVER (PARTITION BY run, item_id ORDER BY pos) = 1)""", """runs AS (SELECT run, avg(nll) AS mean_nll, avg(rank) AS mean_first_rank
  FROM item_lp LEFT JOIN firsts USING (run, item_id) GROUP BY run)""") + f"""SELECT run, {r('mean_nll')} AS mean_nll, {r('mean_first_rank')} AS mean_first_rank,
{r("mean_nll - (SELECT mean_nll FROM runs WHERE run = 'O')")} AS delta_nll, mean_nll < (SELECT mean_nll FROM runs WHERE run = 'O') AS backfire FROM runs""")
def l03(t: Tables):
    return L.likelihood_summary(t.token_logprobs(), "O")


@register("l04_preference_loss", with_(S.TOKENS, ITEM_LP) + f"""SELECT a.run, a.item_id, {r("greatest(z, 0) + ln(1 + exp(-abs(z)))")} AS loss
FROM (SELECT m.run, m.item_id, 0.5::DOUBLE * (m.mean_logprob - b.mean_logprob) AS z FROM item_lp m JOIN item_lp b ON b.item_id = m.item_id AND b.run = 'O' WHERE m.run <> 'O') a""")
def l04(t: Tables):
    return L.preference_loss(L.item_likelihood(t.token_logprobs()), "O", 0.5)


@register("l05_answer_span", with_(S.QA_LISTS) + f"""SELECT entity, turn, start, n - start AS n_supervised FROM (SELECT entity, turn, n,
 coalesce(list_max(list_filter(range(0, greatest(n - m, -1) + 1), lambda i: tok[i + 1] = ans[1] AND tok[i + 1 : i + m] = ans)), least(np, n - 1)) AS start
 FROM (SELECT *, len(tok) AS n, len(ans) AS m FROM (SELECT entity, turn, list_concat({S.words('question')}, {S.words('answer')}) AS tok,
   {S.words('answer')} AS ans, len({S.words('question')}) AS np FROM qa_lists)))""")
def l05(t: Tables):
    q, a = T.split_words("question"), T.split_words("answer")
    seq = t.qa_lists().select(
        F.struct("entity", "turn").alias("item_id"), F.concat(q, a).alias("tokens"),
        a.alias("answer_tokens"), F.size(q).alias("prompt_len"),
    )
    return L.answer_span(seq).select("item_id.entity", "item_id.turn", "start", "n_supervised")


# -- neighbourhood ---------------------------------------------------------------------
_LEAK = f"""least(1.0::DOUBLE, len(list_filter(parts, lambda p: contains(lower(response), p)))::DOUBLE / greatest(1, len(parts)))"""
LEAKED = f"""leaked AS (SELECT *, {_LEAK} AS leakage FROM (SELECT *, list_filter({S.words('lower(forget_name)')}, lambda p: length(p) > 2) AS parts FROM probes))"""
_N = with_(S.PROBES, LEAKED)


def leaked(t: Tables):
    return t.probes().withColumn("leakage", R.name_part_leakage("response", "forget_name"))


@register("r09_name_part_leakage", _N + f"SELECT neighbor, {r('leakage')} AS leakage FROM leaked")
def r09(t: Tables):
    return leaked(t).select("neighbor", "leakage")


@register("n01_entity_leakage", _N + f"""SELECT entity, relation, {r("avg(leakage)")} AS mean, count(*) AS n, {r("any_value(em)")} AS entity_mean, any_value(en) AS entity_n
FROM leaked JOIN (SELECT entity, avg(leakage) AS em, count(*) AS en FROM leaked GROUP BY entity) USING (entity) GROUP BY entity, relation""")
def n01(t: Tables):
    return N.entity_leakage(leaked(t))


_REL = "(SELECT entity, relation, avg(leakage) AS m, sum(leakage) AS s, count(*) AS n FROM leaked GROUP BY entity, relation)"


@register("n02_cnis", _N + f"SELECT entity, {r('1 - avg(m)')} AS cnis_macro, {r('1 - sum(s) / sum(n)')} AS cnis_micro FROM {_REL} GROUP BY entity")
def n02(t: Tables):
    return N.cnis(leaked(t))


@register("n02_cnis_weighted", _N + f"""SELECT entity, {r('1 - sum(w * m) / sum(w)')} AS cnis_macro, {r('1 - sum(s) / sum(n)')} AS cnis_micro
FROM (SELECT *, CASE relation WHEN 'en' THEN 2.0 WHEN 'fr' THEN 0.5 ELSE 1.0 END AS w FROM {_REL}) GROUP BY entity""")
def n02_weighted(t: Tables):
    return N.cnis(leaked(t), {"en": 2.0, "fr": 0.5})


@register("n03_cnis_summary", _N + f"""SELECT {r('avg(c)')} AS mean, {r('stddev_pop(c)')} AS std, {r('min(c)')} AS min, {r('max(c)')} AS max, count(c) AS n
FROM (SELECT entity, 1 - avg(m) AS c FROM {_REL} GROUP BY entity)""")
def n03(t: Tables):
    return N.cnis_summary(N.cnis(leaked(t)))


NORMED = f"""normed AS (SELECT *, {nfkd_sql('response')} AS rn, {nfkd_sql('label')} AS ln, {nfkd_sql('entity')} AS en,
  row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY entity) AS size FROM leaked WINDOW w AS (PARTITION BY entity ORDER BY md5('42|' || CAST(neighbor AS VARCHAR)), neighbor)),
shuffled AS (SELECT a.*, b.ln AS other_ln, b.label AS other_label FROM normed a JOIN normed b ON a.entity = b.entity AND b.pos = (a.pos + 1) % a.size WHERE a.size >= 2)"""


def _match(lab: str) -> str:
    return f"CASE WHEN {lab} = '' THEN 0.0 WHEN rn = {lab} THEN 1.0 WHEN contains(rn, {lab}) OR contains({lab}, rn) THEN 0.5 ELSE 0.0 END::DOUBLE"


def _leak(lab: str) -> str:
    return f"CASE WHEN rn = '' THEN 0.0 WHEN en <> '' AND contains(rn, en) THEN 1.0 WHEN {lab} <> '' AND contains(rn, {lab}) THEN 0.5 ELSE 0.0 END::DOUBLE"


def normed(t: Tables):
    return leaked(t).select(
        "entity", "relation", "neighbor", "label", "leakage",
        T.norm_unicode("response").alias("rn"), T.norm_unicode("label").alias("ln"), T.norm_unicode("entity").alias("en"),
    )


def shuffled(t: Tables):
    """Only ids and labels travel through the ordering; responses stay where they are."""
    labels = normed(t).select("entity", "neighbor", "ln")
    other = J.shuffled_label_control(labels, 42, "entity", "neighbor", {"ln": "other_ln"})
    return normed(t).join(other.select("neighbor", "other_ln"), "neighbor")


@register("r10_label_match", with_(S.PROBES, LEAKED, NORMED) + f"SELECT neighbor, {_match('ln')} AS score FROM normed")
def r10(t: Tables):
    return normed(t).select("neighbor", R.label_match("rn", F.array("ln")).alias("score"))


@register("r11_entity_neighbor_leakage", with_(S.PROBES, LEAKED, NORMED) + f"SELECT neighbor, {_leak('ln')} AS score FROM normed")
def r11(t: Tables):
    return normed(t).select("neighbor", R.entity_neighbor_leakage("rn", "en", "ln").alias("score"))


@register("j05_shuffled_label_control", with_(S.PROBES, LEAKED, NORMED) + "SELECT entity, neighbor, label, other_label FROM shuffled")
def j05(t: Tables):
    labels = t.probes().select("entity", "neighbor", "label")
    return J.shuffled_label_control(labels, 42, "entity", "neighbor", {"label": "other_label"})


def _control_sql(score: str, other: str, band: str) -> str:
    return with_(S.PROBES, LEAKED, NORMED, f"per AS (SELECT entity, count(*) AS n, avg({score}) AS c, avg({other}) AS s FROM shuffled GROUP BY entity)") + f"""
SELECT entity, n, {r('c')} AS correct, {r('s')} AS shuffled, {r('c - s')} AS delta, NULL AS band FROM per
UNION ALL SELECT NULL, count(*), {r('avg(c)')}, {r('avg(s)')}, {r('avg(c) - avg(s)')}, CASE WHEN {band} >= 0.05 THEN 'meaningful' WHEN {band} >= 0.02 THEN 'weak' ELSE 'none' END FROM per"""


@register("n04_shuffled_control_labels", _control_sql(_match("ln"), _match("other_ln"), "avg(c) - avg(s)"))
def n04_labels(t: Tables):
    rows = shuffled(t).withColumns(
        {"score": R.label_match("rn", F.array("ln")), "shuffled_score": R.label_match("rn", F.array("other_ln"))}
    )
    return N.shuffled_control_summary(rows)


@register("n04_shuffled_control_leakage", _control_sql("1 - leakage", f"1 - {_leak('other_ln')}", "abs(avg(c) - avg(s))"))
def n04_leakage(t: Tables):
    other = R.entity_neighbor_leakage("rn", "en", "other_ln")
    rows = shuffled(t).withColumns({"score": 1 - F.col("leakage"), "shuffled_score": 1 - other})
    return N.shuffled_control_summary(rows, signed=False)


@register("j10_edge_probe_join", with_(EDGES) + """SELECT e.entity, e.relation, e.neighbor, t.i AS template_index, replace(t.q, '{neighbor}', e.neighbor) AS probe_q, md5(coalesce(d.text, '')) AS response
FROM edges e JOIN templates t USING (relation) LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = e.neighbor AND d.doc_id % 2 = t.i""")
def j10(t: Tables):
    e = edges(t)
    answered = e.join(
        t.documents().select(
            F.col("doc_id").cast("string").alias("neighbor"), (F.col("doc_id") % 2).cast("int").alias("template_index"),
            F.col("text").alias("response"),
        ),
        "neighbor",
    )
    return J.edge_probe_join(e, answered).select(
        "entity", "relation", "neighbor", "template_index", "probe_q", F.md5("response").alias("response")
    )


@register("j11_answers_in_corpus", f"""SELECT b.item_id AS answer_id, d.doc_id AS text_id FROM (SELECT item_id, {S.norm_answer('text')} AS a FROM benchmark) b
JOIN (SELECT doc_id, {S.norm_answer('text')} AS t FROM documents) d ON b.a <> '' AND contains(d.t, b.a)""")
def j11(t: Tables):
    answers = t.table("benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("answer"))
    texts = t.documents().select(F.col("doc_id").alias("text_id"), "text")
    return J.answers_in_corpus(answers, texts)


@register("j11_answers_in_corpus_compact", f"""SELECT b.item_id AS answer_id, d.doc_id AS text_id FROM (SELECT item_id, {S.norm_compact('text')} AS a FROM benchmark) b
JOIN (SELECT doc_id, {S.norm_compact('text')} AS t FROM documents) d ON b.a <> '' AND contains(d.t, b.a)""")
def j11_compact(t: Tables):
    answers = t.table("benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("answer"))
    texts = t.documents().select(F.col("doc_id").alias("text_id"), "text")
    return J.answers_in_corpus(answers, texts, T.norm_compact)
