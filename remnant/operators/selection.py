"""Choosing, expanding and numbering evaluation items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remnant.functions import fixed_values as V
from remnant.functions import text as T
from remnant.functions.common import hash_key
from remnant.operators.ordering import with_position


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (T.squash_ws(c) != "")


def drop_invalid_items(items: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Items with image and question keys, a non-blank answer and an existing image."""
    out = items.filter(
        F.col("image").isNotNull() & F.col("question").isNotNull() & _present("answer")
    ).withColumns({"question": T.squash_ws("question"), "answer": T.squash_ws("answer")})
    if files is not None:
        out = out.join(files.select(F.col("path").alias("image")), "image", "left_semi")
    return out


def limit_items(items: DataFrame, n: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """First n items in the given order (of each group); n <= 0 keeps all.

    The rank filter lets Spark drop rows beyond n before the shuffle, so a large group
    sends at most n rows per input task.
    """
    if n <= 0:
        return items
    if not by:
        return items.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return items.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_k_per_entity(items: DataFrame, k: int, order: list[str], entity: str = "entity") -> DataFrame:
    return limit_items(items, k, order, [entity])


def valid_qas(qas: DataFrame) -> DataFrame:
    return qas.filter(_present("question") & _present("answer"))


def spread_k_per_entity(
    qas: DataFrame, k: int, order: list[str], entity: str = "entity",
    drop_blank: bool = True,
) -> DataFrame:
    """k evenly spaced items per entity (integer positions i*(n-1)/(k-1)); all when n <= k."""
    rows = valid_qas(qas) if drop_blank else qas
    if k <= 0:
        return rows
    placed = with_position(rows, [entity], order, "_pos", "_n")
    if k == 1:
        keep = F.col("_pos") == 0
    else:
        picks = F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda i: F.floor(i.cast("bigint") * (F.col("_n") - 1) / F.lit(k - 1)),
        )
        keep = (F.col("_n") <= k) | F.array_contains(picks, F.col("_pos"))
    return placed.filter(keep).drop("_pos", "_n")


def identity_balanced(
    qas: DataFrame, k: int, order: list[str], entity: str = "entity"
) -> DataFrame:
    """k = 1: first question that mentions a name, else the first; otherwise evenly spread."""
    if k != 1:
        return spread_k_per_entity(qas, k, order, entity, drop_blank=False)
    other = [c for c in qas.columns if c != entity]
    no_name = ~F.contains(T.norm_terms("question"), F.lit("name"))
    best = F.min_by(F.struct(*other), F.struct(no_name.alias("no_name"), *order))
    return qas.groupBy(entity).agg(best.alias("q")).select(
        entity, *[F.col("q")[c].alias(c) for c in other]
    )


def name_question_subset(identities: DataFrame) -> DataFrame:
    """One question per identity: first about the name, else the first, else the default."""
    qa = F.col("qa_list")
    named = F.get(F.filter(qa, lambda x: T.is_name_question(x["question"])), F.lit(0))
    pick = F.coalesce(named, F.get(qa, F.lit(0)))
    return identities.withColumn("_qa", pick).select(
        "entity",
        F.coalesce(F.col("_qa")["question"], F.lit(V.DEFAULT_NAME_QUESTION)).alias("question"),
        F.coalesce(F.col("_qa")["answer"], F.col("entity").cast("string")).alias("answer"),
    )


def explode_qas(identities: DataFrame, k: int = 0, clean: bool = False) -> DataFrame:
    """Nested question lists as rows; blanks dropped, `qa_index` counts selected ones."""
    ok = F.filter(
        "qa_list",
        lambda x: (T.squash_ws(x["question"]) != "") & (T.squash_ws(x["answer"]) != ""),
    )
    n = F.size("_qas")
    if k > 1:
        step = F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda i: F.get("_qas", F.floor(i * (n - 1) / F.lit(k - 1)).cast("int")),
        )
        chosen = F.when(n <= k, F.col("_qas")).otherwise(step)
    elif k == 1:
        chosen = F.slice("_qas", 1, 1)
    else:
        chosen = F.col("_qas")
    rows = identities.withColumn("_qas", ok).select(
        "entity", F.posexplode(chosen).alias("qa_index", "qa")
    )
    answer = F.col("qa")["answer"]
    return rows.select(
        "entity",
        "qa_index",
        F.trim(F.col("qa")["question"]).alias("question"),
        (T.clean_answer(answer) if clean else F.trim(answer)).alias("answer"),
        F.filter(F.col("qa")["keywords"], lambda x: F.trim(x) != "").alias("keywords"),
    )


def build_forget_retain(samples: DataFrame, files: DataFrame, max_rephrases: int = 5) -> DataFrame:
    """Forget row per sample with up to five rephrases; retain rows from the locality pairs."""

    def plain(q: Column) -> Column:
        return F.trim(F.replace(q, F.lit("nq question: "), F.lit("")))

    valid = samples.join(files.select(F.col("file_id").alias("image_id"), "path"), "image_id")
    rephrases = F.filter(
        F.transform(
            F.slice(F.coalesce("rephrase", F.array().cast("array<string>")), 1, max_rephrases), plain
        ),
        lambda q: q != "",
    )
    answer = F.trim("pred")
    forget = valid.select(
        F.lit("forget").alias("split"),
        F.concat(F.lit("unlok_"), F.col("id").cast("string")).alias("entity"),
        F.col("path").alias("image"),
        F.trim("src").alias("question"),
        answer.alias("answer"),
        F.array(F.lower(answer), answer).alias("aliases"),
        rephrases.alias("rephrases"),
        "image_id",
        F.col("id").alias("sample_id"),
    )
    pairs = F.filter(
        F.arrays_zip(F.col("loc").alias("q"), F.col("loc_ans").alias("a")),
        lambda p: p["q"].isNotNull() & p["a"].isNotNull(),
    )
    local = valid.select("id", "image_id", "path", F.explode(pairs).alias("p")).select(
        "id", "image_id", "path", plain(F.col("p")["q"]).alias("q"), F.trim(F.col("p")["a"]).alias("a")
    )
    retain = local.filter((F.col("q") != "") & (F.col("a") != "")).select(
        F.lit("retain").alias("split"),
        F.concat(F.lit("loc_"), F.col("id").cast("string")).alias("entity"),
        F.col("path").alias("image"),
        F.col("q").alias("question"),
        F.col("a").alias("answer"),
        F.array(F.lower("a"), F.col("a")).alias("aliases"),
        F.array().cast("array<string>").alias("rephrases"),
        "image_id",
        F.col("id").alias("sample_id"),
    )
    return forget.unionByName(retain)


def item_ids(
    items: DataFrame, order: list[str], by: list[str], entity: str = "entity",
) -> DataFrame:
    """Stable id: entity and the position within the split, three digits or more."""
    placed = with_position(items, by, order, "_pos")
    number = F.col("_pos").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return placed.withColumn(
        "item_id", F.concat(F.col(entity).cast("string"), F.lit("_"), padded)
    ).drop("_pos")


def hash_shuffle(
    df: DataFrame, key: str, seed: int, epoch: int, by: list[str] | None = None,
) -> DataFrame:
    """Deterministic order of an epoch: `pos` by the hash of (seed + epoch, key)."""
    keyed = df.withColumn("_h", hash_key(seed + epoch, key))
    return with_position(keyed, by or [], ["_h", key], "pos").drop("_h")


def cycled_steps(
    steps: DataFrame, pool: DataFrame, key: str, seed: int, by: list[str] | None = None,
) -> DataFrame:
    """The pool row of each step when epochs follow one another: by, step, epoch, pos, key.

    `steps` holds by and step (0, 1, ...).  A pool of n rows is used up after n steps and then
    shuffled anew.  Only epochs that a step falls into are ordered.
    """
    by = by or []
    sizes = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sized = steps.join(sizes, by) if by else steps.crossJoin(sizes.filter("_n > 0"))  # one row
    placed = sized.select(
        *by, "step", F.floor(F.col("step") / F.col("_n")).alias("epoch"), (F.col("step") % F.col("_n")).alias("pos")
    )
    epochs = placed.select(*by, "epoch").distinct()
    rows = pool.select(*by, key)
    dealt = rows.join(epochs, by) if by else rows.join(epochs)
    keyed = dealt.withColumn("_h", F.md5(F.concat_ws("|", (F.col("epoch") + seed).cast("string"), F.col(key).cast("string"))))
    order = with_position(keyed, [*by, "epoch"], ["_h", key], "pos").drop("_h")
    return placed.join(order, [*by, "epoch", "pos"]).select(*by, "step", "epoch", "pos", key)
