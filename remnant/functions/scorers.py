"""Response scorers: predicates and scores over a response and the columns of its item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from remnant.functions import fixed_values as V
from remnant.functions import text as T
from remnant.functions.common import as_col, let


def _within(part: Column, whole: Column) -> Column:
    """Non-blank `part` occurs inside `whole`."""
    return let(part, lambda p: (p != "") & F.contains(whole, p))


def _has_word(word: Column, text: Column) -> Column:
    return F.contains(text, F.concat(F.lit(" "), word, F.lit(" ")))


def entity_or_answer(response, entity, aliases, answer) -> Column:
    """Entity alias or gold answer appears in the response after normalization.

    One normalized form serves both tests: without its spaces for substrings, with them for
    whole words.
    """

    def test(candidate, r: Column, by_words) -> Column:
        def check(text: Column) -> Column:
            compact = F.replace(text, F.lit(" "), F.lit(""))
            words = F.array_distinct(F.split(F.trim(text), " "))
            return (compact != "") & (
                F.contains(r["compact"], compact) | let(words, lambda w: by_words(w, r["text"]))
            )

        return let(T.words_text(candidate), check)

    def all_words(w: Column, text: Column) -> Column:
        return F.forall(w, lambda x: _has_word(x, text))

    def enough_words(w: Column, text: Column) -> Column:
        found = F.size(F.filter(w, lambda x: _has_word(x, text)))
        return F.when(F.size(w) <= 5, found == F.size(w)).otherwise(found >= 2)

    names = F.concat(
        F.coalesce(as_col(aliases), F.array().cast("array<string>")),
        F.array(T.text_or_blank(entity)),
    )

    def hit(r: Column) -> Column:
        named = F.exists(names, lambda a: test(a, r, all_words))
        return named | ((T.text_or_blank(answer) != "") & test(answer, r, enough_words))

    form = lambda t: F.struct(F.replace(t, F.lit(" "), F.lit("")).alias("compact"), t.alias("text"))
    return let(let(T.words_text(response), form), hit)


def refusal(response, phrases=None) -> Column:
    """Response contains a refusal phrase; independent of correctness."""
    low = F.lower(T.clean_generated(response))
    hit = F.lit(False)
    for p in phrases or V.REFUSAL_PHRASES:
        hit = hit | F.contains(low, F.lit(p))
    return hit


def _any_candidate(response: Column, answer, aliases, norm) -> Column:
    candidates = F.concat(
        F.array(T.text_or_blank(answer)),
        F.coalesce(as_col(aliases), F.array().cast("array<string>")),
    )
    return let(norm(response), lambda r: F.exists(candidates, lambda c: _within(norm(c), r)))


def answer_or_alias_normalized(response, answer, aliases) -> Column:
    return _any_candidate(as_col(response), answer, aliases, T.norm_answer)


def _lower_strip(c) -> Column:
    return F.lower(F.regexp_replace(T.text_or_blank(c), r"(?U)^\s+|\s+$", ""))


def answer_or_alias_raw(response, answer, aliases) -> Column:
    return _any_candidate(as_col(response), answer, aliases, _lower_strip)


def answer_raw(response, answer, blank_counts: bool = False) -> Column:
    """Lower-cased answer inside the lower-cased response; blank answers are opt-in."""
    a, r = F.lower(T.text_or_blank(answer)), F.lower(T.text_or_blank(response))
    return F.contains(r, a) if blank_counts else _within(a, r)


def keyword_terms(keywords, entity, answer) -> Column:
    """Distinct normalized keywords, entity and answer, in that order."""
    terms = F.concat(
        F.coalesce(as_col(keywords), F.array().cast("array<string>")),
        F.array(T.text_or_blank(entity), T.text_or_blank(answer)),
    )
    return F.array_distinct(F.filter(F.transform(terms, T.norm_terms), lambda t: t != ""))


def keyword_match(response, keywords, entity, answer) -> Column:
    terms = keyword_terms(keywords, entity, answer)
    return let(
        T.norm_terms(response),
        lambda r: F.exists(terms, lambda t: (F.length(t) >= 2) & F.contains(r, t)),
    )


def exact_name(response, name) -> Column:
    return _within(T.norm_name(name), T.norm_name(response))


def recovery_score(response, entity, answer) -> Column:
    """1 for name and answer word, 0.5 for one of them, else 0."""
    r = F.lower(T.text_or_blank(response))
    named = F.contains(r, F.lower(T.text_or_blank(entity)))
    words = F.filter(
        F.split(F.lower(T.text_or_blank(answer)), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 3
    )
    answered = F.exists(F.slice(words, 1, 3), lambda w: F.contains(r, w))
    return (named.cast("double") + answered.cast("double")) / F.lit(2.0)


def name_part_leakage(response, name) -> Column:
    """Share of name parts longer than two characters found in the response."""
    r = F.lower(T.text_or_blank(response))
    parts = F.filter(T.split_words(F.lower(T.text_or_blank(name))), lambda p: F.length(p) > 2)
    hits = F.size(F.filter(parts, lambda p: F.contains(r, p)))
    return F.least(F.lit(1.0), hits.cast("double") / F.greatest(F.lit(1), F.size(parts)))


def label_match(response_norm, labels_norm) -> Column:
    """First label that equals (1) or contains / is contained in (0.5) the response.

    Takes already normalized text.  A blank response is contained in every label and
    scores 0.5.
    """
    r = as_col(response_norm)
    scores = F.transform(
        F.filter(as_col(labels_norm), lambda x: x.isNotNull() & (x != "")),
        lambda lab: F.when(r == lab, F.lit(1.0))
        .when(F.contains(r, lab) | F.contains(lab, r), F.lit(0.5))
        .otherwise(F.lit(0.0)),
    )
    return F.coalesce(F.get(F.filter(scores, lambda s: s > 0), F.lit(0)), F.lit(0.0))


def entity_neighbor_leakage(response_norm, entity_norm, neighbor_norm) -> Column:
    """1 when the entity is mentioned, 0.5 for the neighbor, else 0 (normalized text)."""
    r, e, n = as_col(response_norm), as_col(entity_norm), as_col(neighbor_norm)
    return (
        F.when(r == "", F.lit(0.0))
        .when(_within(e, r), F.lit(1.0))
        .when(_within(n, r), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def unique_token_ratio(tokens: Column) -> Column:
    return F.size(F.array_distinct(tokens)).cast("double") / F.greatest(F.size(tokens), F.lit(1))


def generation_collapse(response) -> Column:
    """More than four tokens of which fewer than 30 percent are distinct."""
    tokens = T.split_words(response)
    return (F.size(tokens) > 4) & (unique_token_ratio(tokens) < V.COLLAPSE_TOKEN_RATIO)


def suppressed_output(response) -> Column:
    """Refusal-like, empty or non-substantive response."""
    return refusal(response) | (T.norm_compact(response) == "")
