"""Token likelihood summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_likelihood(tokens: DataFrame) -> DataFrame:
    """Mean log probability (with the small count offset) and NLL over supervised tokens."""
    lp = F.when(F.col("supervised"), F.col("logprob"))
    n = F.count_if("supervised")
    total = F.coalesce(F.sum(lp), F.lit(0.0))
    return tokens.groupBy("run", "item_id").agg(
        n.alias("n_tokens"), (total / (n + F.lit(1e-8))).alias("mean_logprob"), (-F.avg(lp)).alias("nll")
    )


def likelihood_summary(tokens: DataFrame, base_run: str) -> DataFrame:
    """Mean NLL and first supervised token's mean rank per run, beside the base run."""
    supervised = F.col("supervised")
    items = tokens.groupBy("run", "item_id").agg(
        (-F.avg(F.when(supervised, F.col("logprob")))).alias("nll"),
        F.min_by(
            F.when(supervised, F.col("rank")), F.when(supervised, F.col("pos"))
        ).alias("first_rank"),
    )
    runs = items.groupBy("run").agg(
        F.avg("nll").alias("mean_nll"), F.avg("first_rank").alias("mean_first_rank")
    )
    base_nll = runs.filter(F.col("run") == base_run).agg(F.max("mean_nll")).scalar()
    # The base run differs from itself by exactly zero, whatever order its sum was taken in.
    delta = F.when(F.col("run") == base_run, 0.0).otherwise(F.col("mean_nll") - base_nll)
    return runs.withColumn("delta_nll", delta).select(
        "run", "mean_nll", "mean_first_rank", "delta_nll", (F.col("delta_nll") < 0).alias("backfire")
    )


def preference_loss(item_lp: DataFrame, base_run: str, beta: float) -> DataFrame:
    """-log sigmoid(-beta (lp_run - lp_base)) per item, in overflow-safe form."""
    base = item_lp.filter(F.col("run") == base_run).select(
        "item_id", F.col("mean_logprob").alias("base_lp")
    )
    z = (F.col("mean_logprob") - F.col("base_lp")) * F.lit(float(beta))
    loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return (
        item_lp.filter(F.col("run") != base_run).join(base, "item_id").select("run", "item_id", loss.alias("loss"))
    )


def answer_span(sequences: DataFrame) -> DataFrame:
    """Start of the last occurrence of the answer tokens (zero-based), else the prompt length."""
    tokens, answer = F.col("tokens"), F.col("answer_tokens")
    n, m = F.size(tokens), F.size(answer)
    starts = F.when(
        (m > 0) & (m <= n),
        F.filter(
            F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))),
            # The first token is compared before a slice is built.
            lambda i: (F.get(tokens, i) == F.get(answer, F.lit(0)))
            & (F.slice(tokens, i + 1, m) == answer),
        ),
    )
    start = F.coalesce(F.array_max(starts), F.least(F.col("prompt_len"), n - 1))
    return sequences.select("item_id", start.alias("start"), (n - start).alias("n_supervised"))
