"""Quality rules learned as a decision list.

Statistics of every whole text are computed once.  From a bounded labelled sample of these
statistics (numbers, not texts), sequential covering learns rules for bad documents: a rule is
grown threshold by threshold for the largest information gain, pruned on rows held back from
growing, and accepted while it is precise there; then what it covers is set aside and the next
rule is grown.  The list is emitted as one ordered Spark conditional expression, readable as
`explain(rules)`.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remnant.llm.common import bounded_labels, text_udf, words
from remnant.sources.storage import materialize

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = re.compile(r"[#*$%&|<>]")
LINE_WORD = re.compile(r"[^\x20\x09-\x0D]")
LABELLED = 20_000
SEED = 5
PRECISION = 0.97  # of a rule, on rows held back
MAX_RULES = 16
MAX_CONDITIONS = 4
CUTS = 64  # thresholds tried per feature

STATISTICS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_upper bigint, n_alpha bigint, n_digits bigint, n_marks bigint, n_distinct bigint, n_same_next bigint, n_lines bigint, n_end_lines bigint"
)


def repeat_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more; h: word hashes."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[at] > 1)
    mark = np.zeros(len(h) + 1, np.int64)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + window, -1)
    return int((np.cumsum(mark)[:-1] > 0).sum())


def statistics_of(text: str | None) -> tuple:
    """The numbers of STATISTICS for one text; 64-bit word hashes stand for words in windows."""
    w = words(text)
    if not w:
        body = text or ""
        return (0, 0, len(SYMBOLS.findall(body)), 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen: set[str] = set()
    dup = lines = ends = 0
    for line in text.split("\n"):
        if LINE_WORD.search(line):
            lines += 1
            ends += line.rstrip()[-1:] in ".!?…\"'"
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    codes = np.bincount(data, minlength=256)
    blank = int(codes[9:14].sum() + codes[32])
    return (
        len(w), len(text) - blank, len(SYMBOLS.findall(text)), dup, repeat_words(h),
        int(codes[65:91].sum()), int(codes[65:91].sum() + codes[97:123].sum() + codes[0xC3:0xF5].sum()), int(codes[48:58].sum()),
        int(codes[33] + codes[63]), len(np.unique(h)), int((h[1:] == h[:-1]).sum()), lines, ends,
    )


def _statistics(texts: list) -> dict:
    names = [f.split()[0] for f in STATISTICS.split(", ")]
    rows = [statistics_of(t) for t in texts]
    return {name: [r[k] for r in rows] for k, name in enumerate(names)}


def statistics(text: Column) -> Column:
    """Struct of STATISTICS; null, empty and blank texts have no words and zeros."""
    return text_udf(_statistics, STATISTICS)(text.cast("string"))


def base_failed(s: Column) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """Ratios that rules put thresholds on; a text without words has zeros."""
    words_ = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return {
        "mean_word_chars": s["word_chars"] / words_,
        "symbols_per_word": s["n_symbols"] / words_,
        "dup_line_share": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "repeat_share": s["n_repeat_words"] / words_,
        "upper_share": s["n_upper"] / F.greatest(s["n_alpha"], F.lit(1)),
        "digits_per_char": s["n_digits"] / F.greatest(s["word_chars"], F.lit(1)),
        "marks_per_word": s["n_marks"] / words_,
        "distinct_share": s["n_distinct"] / words_,
        "same_next_share": s["n_same_next"] / words_,
        "ended_line_share": s["n_end_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "words_per_line": s["n_words"] / F.greatest(s["n_lines"], F.lit(1)),
        "n_words": s["n_words"].cast("double"),
    }


class Condition(NamedTuple):
    feature: str
    above: bool  # value >= cut, else value < cut
    cut: float


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    n = len(next(iter(x.values())))
    out = np.ones(n, bool)
    for c in rule:
        out &= (x[c.feature] >= c.cut) if c.above else (x[c.feature] < c.cut)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """Add the threshold of largest gain until no bad row is mixed with good ones."""
    rule: list[Condition] = []
    inside = np.ones(len(y), bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = int((y & inside).sum()), int((~y & inside).sum())
        if not p0 or not n0:
            break
        base, best = math.log2(p0 / (p0 + n0)), (1e-9, None, None)
        for name in sorted(x):
            v = x[name]
            cuts = np.unique(np.quantile(v[inside], np.linspace(0, 1, CUTS + 1), method="nearest"))
            cuts = np.unique(np.concatenate([cuts, np.quantile(v[inside & y], np.linspace(0, 1, 9), method="nearest")]))
            for cut in cuts:
                for above in (True, False):
                    got = inside & ((v >= cut) if above else (v < cut))
                    p = int((y & got).sum())
                    if not p:
                        continue
                    gain = p * (math.log2(p / int(got.sum())) - base)
                    if gain > best[0]:
                        best = (gain, Condition(name, above, float(cut)), got)
        if best[1] is None:
            break
        rule.append(best[1])
        inside = best[2]
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """The shortest beginning of the rule with the largest (bad - good) / covered."""

    def worth(k: int) -> float:
        got = _holds(rule[:k], x)
        n = int(got.sum())
        return (2 * int((y & got).sum()) - n) / n if n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Rules for bad rows, in the order of learning; rows 2 of 3 grow, the third prunes.

    Without bad or without good rows there is nothing to learn: no rules.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    turn = np.arange(len(bad)) % 3 == 2
    while len(rules) < MAX_RULES:
        grow, prune = left & ~turn, left & turn
        if bad[grow].sum() < 3 or not (~bad[grow]).any():
            break
        rule = _prune(_grow({k: v[grow] for k, v in x.items()}, bad[grow]), {k: v[prune] for k, v in x.items()}, bad[prune])
        if not rule:
            break
        got = _holds(rule, x) & left
        held = got & turn
        good = int((~bad & held).sum())
        if not held.sum() or good > (1 - PRECISION) * int(held.sum()) or bad[got].sum() < 3:
            break
        rules.append(rule)
        left &= ~got
    return rules


def expression(rules: list[Rule], value: dict[str, Column]) -> Column:
    """Ordered conditions: the number of the first rule that fits, null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        fits = F.lit(True)
        for c in rule:
            fits &= (value[c.feature] >= F.lit(c.cut)) if c.above else (value[c.feature] < F.lit(c.cut))
        out = F.when(fits, F.lit(k + 1)).otherwise(out)
    return out


def explain(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>=' if c.above else '<'} {c.cut:.6g}" for c in r) for r in rules]


def learn_rules(stats: DataFrame, labels: DataFrame, bound: int = LABELLED) -> list[Rule]:
    """Rules from a bounded labelled sample; stats: doc_id, s (struct of STATISTICS)."""
    sample = bounded_labels(labels, "quality", bound, SEED)
    # Of rows that repeat an id the least counts, so that the sample stays bounded.
    once = stats.join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min("s").alias("s"))
    rows = once.select("doc_id", "y", *[v.alias(k) for k, v in features(F.col("s")).items()])
    found = rows.toPandas().sort_values(["doc_id", "n_words"], kind="stable")
    order = np.argsort([xxhash.xxh64_intdigest(str(i), SEED) for i in found["doc_id"]], kind="stable")
    found = found.iloc[order]
    x = {k: found[k].to_numpy(float) for k in features(F.col("s"))}
    return learn(x, found["y"].to_numpy(int) == 0)


def judge(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> tuple[DataFrame, list[Rule]]:
    """doc_id, s, base_failed, rule (number or null), kept per row of docs; and the rules.

    Null, empty and blank texts have zeros and fail the base test.  Rows that repeat an id are
    judged each by its own text.  Other columns of docs are ignored.
    """
    stats = materialize(docs.select("doc_id", statistics(F.col("text")).alias("s")))
    rules = learn_rules(stats, labels, bound)
    failed = base_failed(F.col("s"))
    rows = stats.withColumn("base_failed", failed).withColumn("rule", expression(rules, features(F.col("s"))))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """The rows of docs, with all columns, that neither the base test nor a learned rule rejects.

    The rules are learned from the labelled documents alone, so every text is measured once.
    """
    sample = F.broadcast(bounded_labels(labels, "quality", bound, SEED).select("doc_id"))  # bounded by `bound`
    labelled = docs.join(sample, "doc_id", "left_semi").select("doc_id", statistics(F.col("text")).alias("s"))
    rules = learn_rules(labelled, labels, bound)
    s = F.col("s")
    rows = docs.select(F.struct("*").alias("row"), statistics(F.col("text")).alias("s"))
    return rows.filter(~base_failed(s) & expression(rules, features(s)).isNull()).select("row.*")
