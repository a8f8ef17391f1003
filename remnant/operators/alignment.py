"""Joins between runs, items, files and controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remnant.functions import text as T
from remnant.functions.common import hash_key
from remnant.operators.ordering import with_neighbor
from remnant.sources.storage import materialize


def item_key(entity="entity", question="question", answer="answer", position=None) -> Column:
    """entity::question::answer with squashed whitespace; position when both names are blank."""
    e, q, a = T.squash_ws(entity), T.squash_ws(question), T.squash_ws(answer)
    key = F.concat(e, F.lit("::"), q, F.lit("::"), a)
    if position is None:
        return key
    place = F.concat(F.lit("position::"), F.col(position).cast("string"))
    return F.when((e == "") & (q == ""), place).otherwise(key)


def last_per_item(predictions: DataFrame, order: list[str], keys=("run", "split", "item_key")) -> DataFrame:
    """Duplicates of one item in a run: the last one wins (partial aggregation, no sort)."""
    keys = list(keys)
    other = [c for c in predictions.columns if c not in keys]
    best = F.max_by(F.struct(*other), F.struct(*order))
    return predictions.groupBy(*keys).agg(best.alias("r")).select(
        *keys, *[F.col("r")[c].alias(c) for c in other]
    )


def align_runs(
    predictions: DataFrame, base_run: str, order: list[str], position: str | None = None
) -> DataFrame:
    """Every other run paired with the base run on common item keys.

    With `position`, a (run, split) that shares no key with the base but has as many rows
    is paired by position instead.
    """
    last = last_per_item(predictions, order)

    def pair(base: DataFrame, runs: DataFrame, on: list[str]) -> DataFrame:
        b = base.select(
            *on,
            F.col("correct").alias("base_correct"),
            F.col("response").alias("base_response"),
        )
        return runs.join(b, on).select(
            "run", "split", "item_key", "entity", "base_correct",
            F.col("correct").alias("method_correct"), "base_response",
            F.col("response").alias("method_response"),
        )

    is_base = F.col("run") == base_run
    keyed = pair(last.filter(is_base), last.filter(~is_base), ["split", "item_key"])
    if position is None:
        return keyed
    sizes = predictions.groupBy("run", "split").agg(F.count(F.lit(1)).alias("n"))
    common = keyed.select("run", "split").distinct()
    fallback = (
        sizes.filter(~is_base)
        .join(sizes.filter(is_base).drop("run"), ["split", "n"])
        .join(common, ["run", "split"], "left_anti")
        .select("run", "split")
    )
    rows = predictions.filter(~is_base).join(fallback, ["run", "split"], "left_semi")
    return keyed.unionByName(pair(predictions.filter(is_base), rows, ["split", position]))


def candidate_file_keys(items: DataFrame, key_exprs: list[Column]) -> DataFrame:
    keys = F.array(*[F.lower(k) for k in key_exprs])
    return items.select("*", F.posexplode(keys).alias("priority", "file_key")).filter(
        F.col("file_key").isNotNull() & (F.col("file_key") != "")
    )


def resolve_files(
    items: DataFrame, files: DataFrame, key: str, key_exprs: list[Column], how: str = "inner"
) -> DataFrame:
    """Path of the first candidate key found in the file index (file_key, path).

    `how="left_anti"` returns the items for which no candidate was found.
    """
    found = candidate_file_keys(items.select(key, *_used(items, key)), key_exprs).join(
        files.select("file_key", "path"), "file_key"
    )
    best = found.groupBy(key).agg(F.min_by("path", F.struct("priority", "path")).alias("path"))
    return items.join(best, key, how)


def _used(items: DataFrame, key: str) -> list[str]:
    return [c for c in items.columns if c != key]


def file_key_index(paths: DataFrame) -> DataFrame:
    """Index by file name and stem, case-folded; the smallest path wins."""
    name = F.lower(F.substring_index("path", "/", -1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return (
        paths.select("path", F.explode(F.array_distinct(F.array(name, stem))).alias("file_key"))
        .groupBy("file_key")
        .agg(F.min("path").alias("path"))
    )


def residual_x_recovery(residuals: DataFrame, recovery: DataFrame) -> DataFrame:
    return (
        residuals.filter(F.col("sim").isNotNull())
        .join(recovery.filter(F.col("score").isNotNull()), "entity")
        .select("entity", "component", "attack", "sim", "score")
    )


def method_x_profile(summary: DataFrame, profile: DataFrame, metrics: list[str]) -> DataFrame:
    """Run summary beside the long form of its known component values."""
    long = profile.unpivot(["run"], metrics, "metric", "value").filter(F.col("value").isNotNull())
    return summary.join(long, "run").select("run", "metric", "value", "mean_recovery")


def shuffled_label_control(
    records: DataFrame, seed: int, entity: str = "entity", key: str = "id",
    take: dict[str, str] | None = None,
) -> DataFrame:
    """Give each record the label of the next record of its entity in hashed order.

    Entities with one record are dropped: for them the next record is the record itself.
    """
    take = take or {"label": "other_label", "aliases": "other_aliases"}
    keyed = records.withColumn("_h", hash_key(seed, key))
    out = with_neighbor(
        keyed, [entity], ["_h", key], {**take, key: "_other_key"}
    )
    return out.filter(F.col("_other_key") != F.col(key)).drop("_h", "_other_key")


def mismatched_control(
    items: DataFrame, value: str, seed: int
) -> DataFrame:
    """Each item three times: its own value, another item's value, and a blank one."""
    distinct = items.select(value).distinct().withColumn("_h", hash_key(seed, value))
    nxt = with_neighbor(distinct, [], ["_h", value], {value: "_next"})
    nxt = nxt.select(value, F.when(F.col("_next") != F.col(value), F.col("_next")).alias("_next"))
    modes = F.array(
        F.struct(F.lit("correct").alias("mode"), F.col(value).alias("used_value")),
        F.struct(F.lit("mismatched").alias("mode"), F.col("_next").alias("used_value")),
        F.struct(F.lit("blank").alias("mode"), F.lit(None).cast("string").alias("used_value")),
    )
    return (
        items.join(nxt, value)
        .select(*items.columns, F.explode(modes).alias("m"))
        .select(*items.columns, "m.mode", "m.used_value")
    )


def response_overlap(predictions: DataFrame) -> DataFrame:
    """Share of common items with identical normalized response for each pair of runs.

    Items hold one row per run, so the equality join on the item multiplies rows by the
    number of runs only.  A key that occurs in two splits is two items.  Responses travel as a
    hash of their normalized text.
    """
    key = ["split", "item_key"] if "split" in predictions.columns else ["item_key"]
    norm = T.norm_answer("response")
    rows = predictions.select("run", *key, F.when(norm.isNotNull(), F.md5(norm)).alias("r"))
    a = rows.select(F.col("run").alias("run_a"), *key, F.col("r").alias("ra"))
    b = rows.select(F.col("run").alias("run_b"), *key, F.col("r").alias("rb"))
    half = (
        a.join(b, key)
        .filter(F.col("run_a") <= F.col("run_b"))
        .groupBy("run_a", "run_b")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col("ra") == F.col("rb")).cast("double")).alias("overlap"),
        )
    )
    # The mirror image reuses the aggregated rows.
    both = F.when(F.col("run_a") == F.col("run_b"), F.array(F.struct("run_a", "run_b"))).otherwise(
        F.array(
            F.struct("run_a", "run_b"),
            F.struct(F.col("run_b").alias("run_a"), F.col("run_a").alias("run_b")),
        )
    )
    return half.select(F.explode(both).alias("p"), "n", "overlap").select(
        "p.run_a", "p.run_b", "n", "overlap"
    )


def edge_probe_join(edges: DataFrame, responses: DataFrame) -> DataFrame:
    """Probe questions of the edges with their responses (missing responses are blank)."""
    questions = T.probe_questions(edges)
    return questions.join(
        responses, ["entity", "relation", "neighbor", "template_index"], "left"
    ).withColumn("response", F.coalesce("response", F.lit("")))


GRAM = 8
BLOCK = 32


def answers_in_corpus(answers: DataFrame, texts: DataFrame, norm=T.norm_answer) -> DataFrame:
    """Which answers occur in which texts, under a normalizer: answer_id, text_id.

    An inverted index proposes candidates and the whole normalized text decides.  In an
    answer of three or more words, every inner word must be a whole word of the text; other
    answers (and normalizers without spaces) use character n-grams, and answers shorter than
    the n-gram use themselves.  Each answer is looked up by its rarest entry in the corpus.

    Wherever an answer of 2 * BLOCK - 1 or more characters stands in a text, it covers a whole one
    of the text's consecutive blocks of BLOCK characters: the texts list these alone.  Of the
    answer, BLOCK n-grams in a row meet every place of the cuts; those rarest in the corpus are
    looked up.
    """
    a = answers.select("answer_id", norm("answer").alias("a")).filter(F.col("a") != "")
    t = texts.select("text_id", norm("text").alias("t"))

    def grams(c: str, size: int) -> Column:
        return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?=(.{{{size}}}))"), F.lit(1)))

    def inner_words(c: str) -> Column:
        w = F.split(c, " ")
        return F.array_distinct(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))))

    worded = F.size(F.split("a", " ")) >= 3
    long = F.length("a") >= 2 * BLOCK - 1
    mode = F.when(worded, 0).when(long, BLOCK).otherwise(F.least(F.length("a"), F.lit(GRAM))).alias("mode")
    a = a.select("answer_id", "a", mode)
    # Which entry kinds are needed: at most GRAM + 2 values.
    modes = sorted(r[0] for r in a.select("mode").distinct().collect())
    if not modes:
        return a.select("answer_id").join(t.select("text_id").limit(0), F.lit(True))
    parts = []
    for size in modes:
        mine = a.filter(F.col("mode") == size)
        if size == 0:
            keys = mine.select("answer_id", F.explode(inner_words("a")).alias("g"))
            corpus = t.select("text_id", F.explode(F.array_distinct(F.split("t", " "))).alias("g"))
        elif size == BLOCK:
            place = F.posexplode(F.regexp_extract_all("a", F.lit(f"(?=(.{{{size}}}))"), F.lit(1))).alias("at", "g")
            keys = mine.select("answer_id", place)
            cut = F.regexp_extract_all("t", F.lit(f"(.{{{size}}})"), F.lit(1))
            corpus = t.select("text_id", F.explode(F.array_distinct(cut)).alias("g"))
        else:
            keys = mine.select("answer_id", F.explode(grams("a", size)).alias("g"))
            corpus = t.select("text_id", F.explode(grams("t", size)).alias("g"))
        # Stored: texts are read once, for the counts and for the hits.
        wanted = materialize(corpus.join(keys.select("g").distinct(), "g", "left_semi"))
        seen = wanted.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        if size == BLOCK:
            row = Window.partitionBy("answer_id").orderBy("at").rowsBetween(0, BLOCK - 1)
            counted = keys.join(seen, "g", "left").select("answer_id", "at", "g", F.coalesce("n", F.lit(0)).alias("n"))
            runs = counted.select("answer_id", "at", F.sum("n").over(row).alias("n"), F.count(F.lit(1)).over(row).alias("k"))
            first = runs.filter(F.col("k") == BLOCK).groupBy("answer_id").agg(F.min_by("at", F.struct("n", "at")).alias("first"))
            keys = keys.join(first, "answer_id").filter(F.col("at").between(F.col("first"), F.col("first") + BLOCK - 1))
        elif size in (0, GRAM):
            # An entry absent from the corpus proves that its answer is absent.
            keys = (
                keys.join(seen, "g", "left")
                .groupBy("answer_id")
                .agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
            )
        parts.append(keys.join(wanted, "g").select("answer_id", "text_id"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.distinct()
    # Only the texts that were hit are normalized again.
    met = texts.join(hits.select("text_id").distinct(), "text_id", "left_semi").select("text_id", norm("text").alias("t"))
    return (
        hits.join(a.select("answer_id", "a"), "answer_id")
        .join(met, "text_id")
        .filter(F.contains(F.col("t"), F.col("a")))
        .select("answer_id", "text_id")
    )
