"""Text normalizers and question builders as column expressions.

The normalizers differ on purpose: each scorer depends on its own rule, so none are merged.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from remnant.functions import fixed_values as V
from remnant.functions import kernels
from remnant.functions.common import as_col, let

_WS = r"(?U)\s+"


def text_or_blank(c: Column | str) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def squash_ws(c: Column | str) -> Column:
    """NULL becomes blank, whitespace runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text_or_blank(c), _WS, " "))


def _unmarked(c: Column | str) -> Column:
    """Text with a space in place of each tokenizer marker; enough where spaces are dropped anyway."""
    out = text_or_blank(c)
    for marker in V.GENERATION_MARKERS:
        out = F.replace(out, F.lit(marker), F.lit(" "))
    return out


def clean_generated(c: Column | str) -> Column:
    """Remove tokenizer markers, then squash whitespace."""
    return F.trim(F.regexp_replace(_unmarked(c), _WS, " "))


class _Table(NamedTuple):
    """A replacement of single characters, generated from the Unicode tables of all planes."""

    src: str  # one-to-one, then the characters that go
    dst: str
    multi: dict[str, str]  # the rest: ligatures, fractions, enclosed numbers


def _table(replacement) -> _Table:
    """Table of a function from a character to its text, or to None where the character stays."""
    src, dst, gone, multi = [], [], [], {}
    for code in range(0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        text = replacement(ch)
        if text is None or text == ch:
            continue
        if not text:
            gone.append(ch)
        elif len(text) == 1:
            src.append(ch)
            dst.append(text)
        else:
            multi[ch] = text
    return _Table("".join(src + gone), "".join(dst), multi)


def _without_marks(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", text) if unicodedata.category(x) != "Mn")


def _ascii_form(ch: str) -> str | None:
    base = _without_marks(ch)
    kept = "".join(x if x in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for x in base)
    return kept if kept.strip() or not base else None


@lru_cache(maxsize=1)
def _fold_table() -> _Table:
    """Compatibility forms with small ASCII letters or digits; the others never matter to a normalizer."""
    return _table(_ascii_form)


@lru_cache(maxsize=1)
def _casefold_table() -> _Table:
    return _table(str.casefold)


@lru_cache(maxsize=1)
def _accent_table() -> _Table:
    """All compatibility forms without marks but those of Hangul syllables, which are computed."""
    return _table(lambda ch: None if "\uac00" <= ch <= "\ud7a3" else _without_marks(ch))


def _char_class(chars, gap: int = 1) -> str:
    """Regular-expression class of the characters; those at most `gap` apart become one range."""
    codes, parts, start = sorted(map(ord, chars)), [], None
    for i, code in enumerate(codes):
        start = code if start is None else start
        if i + 1 == len(codes) or codes[i + 1] > code + gap:
            parts.append(f"\\x{{{start:x}}}-\\x{{{code:x}}}")
            start = None
    return "[" + "".join(parts) + "]"


def _replaced(text: Column, table: _Table) -> Column:
    """Text with every character of the table replaced.

    Expanding characters are rare: a coarse class tests for them, and only those that occur in
    the row are looked up.
    """
    forms = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in table.multi.items())), F.lit("\x02"), F.lit("\x01"))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_char_class(table.multi)})"), F.lit(1)))
    expanded = F.aggregate(found, text, lambda acc, ch: F.replace(acc, ch, F.element_at(forms, ch)))
    wide = F.when(text.rlike(_char_class(table.multi, gap=64)), expanded).otherwise(text)
    return F.translate(wide, table.src, table.dst)


_NOT_ASCII = "[^\\x00-\\x7f]"


def fold_ascii(c: Column) -> Column:
    """Lower-cased text with accents and compatibility forms folded; marks are dropped."""
    return let(F.lower(c), lambda t: F.when(t.rlike(_NOT_ASCII), _replaced(t, _fold_table())).otherwise(t))


def norm_compact(c: Column | str) -> Column:
    """Letters and digits only, no spaces left; a match may therefore cross word borders."""
    return F.regexp_replace(fold_ascii(_unmarked(c)), "[^a-z0-9]+", "")


def norm_words(c: Column | str) -> Column:
    """Distinct runs of letters and digits, in order of appearance."""
    return F.array_distinct(
        F.regexp_extract_all(fold_ascii(_unmarked(c)), F.lit("([a-z0-9]+)"), F.lit(1))
    )


def words_text(c: Column | str) -> Column:
    """All words of `norm_words` in order of appearance, each surrounded by single spaces."""
    runs = F.regexp_replace(fold_ascii(_unmarked(c)), "[^a-z0-9]+", " ")
    return F.concat(F.lit(" "), F.trim(runs), F.lit(" "))


def casefold(c: Column) -> Column:
    """Full Unicode case folding, which unlike lower case never looks at neighbours."""
    return let(c, lambda t: F.when(t.rlike(_NOT_ASCII), _replaced(t, _casefold_table())).otherwise(F.lower(t)))


def norm_token(c: Column | str) -> Column:
    out = F.regexp_replace(casefold(text_or_blank(c)), "[^a-z0-9]+", "_")
    return F.regexp_replace(out, "^_+|_+$", "")


def norm_answer(c: Column | str) -> Column:
    out = F.regexp_replace(F.lower(text_or_blank(c)), r"(?U)[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(out, _WS, " "))


def norm_terms(c: Column | str) -> Column:
    out = F.regexp_replace(casefold(text_or_blank(c)), r"[^a-z0-9$+.\- ]+", " ")
    return F.trim(F.regexp_replace(out, " +", " "))


def norm_name(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(casefold(text_or_blank(c)), "[^a-z0-9]+", " "))


def norm_unicode(c: Column | str) -> Column:
    """Decomposed text where everything but letters, digits, `_` and spaces is a space."""
    text = F.trim(F.regexp_replace(F.lower(text_or_blank(c)), _WS, " "))
    # Plain ASCII is its own form and stays in the JVM.
    form = F.arrow_udf(kernels.nfkd, StringType())(F.when(text.rlike(_NOT_ASCII), text))
    text = F.regexp_replace(F.coalesce(form, text), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(text, _WS, " "))


def clean_answer(c: Column | str) -> Column:
    out = F.regexp_replace(text_or_blank(c), r"(?Ui)^\s*the\s+", "")
    out = F.regexp_replace(out, r"(?Ui)^\s*\*{0,2}\s*a\s*:\s*", "")
    out = F.replace(out, F.lit("**"), F.lit(""))
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def split_words(c: Column | str) -> Column:
    """Whitespace words; an empty array for blank text."""
    return F.filter(F.split(squash_ws(c), " "), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(split_words(c))


def accent_free(c: Column) -> Column:
    """Compatibility form without combining marks, letter case kept."""

    def plain(text: Column) -> Column:
        syllables = F.array_distinct(F.regexp_extract_all(text, F.lit("([\uac00-\ud7a3])"), F.lit(1)))
        spelled = F.aggregate(syllables, text, lambda acc, ch: F.replace(acc, ch, _jamo(ch)))
        return _replaced(F.when(text.rlike("[\uac00-\ud7a3]"), spelled).otherwise(text), _accent_table())

    return let(c, lambda t: F.when(t.rlike(_NOT_ASCII), plain(t)).otherwise(t))


def _jamo(syllable: Column) -> Column:
    """Letters of a Hangul syllable: 19 leads, 21 vowels and 28 tails, of which the first is none."""
    at = F.ascii(syllable) - 0xAC00
    row = lambda first, n: F.lit("".join(chr(first + i) for i in range(n)))
    tail = at % 28
    return F.concat(
        F.substring(row(0x1100, 19), F.floor(at / 588).cast("int") + 1, F.lit(1)),
        F.substring(row(0x1161, 21), F.floor(at % 588 / 28).cast("int") + 1, F.lit(1)),
        F.when(tail > 0, F.substring(row(0x11A8, 27), tail, F.lit(1))).otherwise(""),
    )


def build_aliases(name: Column | str) -> Column:
    """Name, first word, last word and accent-free name, each also in lower case."""

    def variants(full: Column, words: Column) -> Column:
        many = F.size(words) >= 2
        parts = [
            full,
            F.when(many, F.element_at(words, -1)),
            F.when(many, F.element_at(words, 1)),
            accent_free(full),
        ]
        both = F.array(*[v for p in parts for v in (p, F.lower(p))])
        return F.array_distinct(F.filter(both, lambda a: a.isNotNull() & (a != "")))

    return let(
        F.trim(text_or_blank(name)), lambda f: let(split_words(f), lambda w: variants(f, w))
    )


def rephrase_question(question: Column | str, aliases: Column | str) -> Column:
    """Replace the first occurrence of each alias, longest first, by a generic reference."""
    ordered = F.array_sort(
        as_col(aliases),
        lambda a, b: F.when(F.length(a) > F.length(b), -1)
        .when(F.length(a) < F.length(b), 1)
        .when(a < b, -1)
        .when(a > b, 1)
        .otherwise(0),
    )

    def step(text: Column, alias: Column) -> Column:
        at = F.instr(F.lower(text), F.lower(alias))
        head = F.substring(text, F.lit(1), at - 1)
        tail = F.substring(text, at + F.length(alias), F.length(text))
        return F.when(at > 0, F.concat(head, F.lit("this person"), tail)).otherwise(text)

    q = F.aggregate(ordered, text_or_blank(question), step)
    q = F.regexp_replace(q, r"(?i)\bwho is\b", "describe")
    q = F.regexp_replace(q, r"(?i)\bwhat is the name of\b", "identify")
    q = F.trim(q)
    return F.when(q == "", F.lit(V.DEFAULT_REPHRASED_QUESTION)).otherwise(q)


def rephrase_templates(entities: DataFrame, entity: str = "entity", n: int = 10) -> DataFrame:
    """The first n rephrase questions of each entity: entity, template_index, question."""
    questions = F.array(
        *[F.replace(F.lit(t), F.lit("{}"), F.col(entity)) for t in V.REPHRASE_TEMPLATES[:n]]
    )
    return entities.select(
        entity, F.posexplode(questions).alias("template_index", "question")
    )


def probe_questions(edges: DataFrame, per_relation: int = V.PROBES_PER_RELATION) -> DataFrame:
    """Probe questions of each (entity, relation, neighbor) edge."""
    branch = None
    for relation, texts in V.PROBE_TEMPLATES.items():
        value = F.array(*[F.lit(t) for t in texts[:per_relation]])
        cond = F.col("relation") == relation
        branch = F.when(cond, value) if branch is None else branch.when(cond, value)
    templates = branch.otherwise(F.array(*[F.lit(t) for t in V.DEFAULT_PROBES[:per_relation]]))
    return edges.select("*", F.posexplode(templates).alias("template_index", "template")).select(
        *edges.columns,
        "template_index",
        F.replace(F.col("template"), F.lit("{neighbor}"), F.col("neighbor").cast("string")).alias(
            "probe_q"
        ),
    )


def assistant_tail(c: Column | str) -> Column:
    """Text after the last assistant marker."""
    return F.regexp_replace(
        F.substring_index(text_or_blank(c), "ASSISTANT:", -1), r"(?U)^\s+|\s+$", ""
    )


def parse_number(c: Column | str) -> Column:
    """Number from text; a percent sign divides by 100; booleans and non-finite give NULL."""
    raw = as_col(c).cast("string")
    body = F.trim(F.replace(raw, F.lit("%"), F.lit("")))
    plain = body.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(plain, body.try_cast("double"))
    value = F.when(F.contains(raw, F.lit("%")), value / F.lit(100.0)).otherwise(value)
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def canonical_dataset(*values: Column | str) -> Column:
    """First data set, in fixed order, one of whose aliases occurs in the joined text."""
    def pick(joined: Column) -> Column:
        out = F.lit(None).cast("string")
        for name in reversed(list(V.DATASET_ALIASES)):
            hit = F.lit(False)
            for alias in V.DATASET_ALIASES[name]:
                hit = hit | F.contains(joined, F.lit(alias))
            out = F.when(hit, F.lit(name)).otherwise(out)
        return out

    return let(casefold(F.concat_ws(" ", *[text_or_blank(v) for v in values])), pick)


def canonical_method(*values: Column | str) -> Column:
    """Method whose alias, longest first, stands between token borders of the joined text."""
    joined = F.concat(
        F.lit("_"), norm_token(F.concat_ws(" ", *[text_or_blank(v) for v in values])), F.lit("_")
    )
    ranked = sorted(
        ((len(a), m, a.replace("-", "_")) for m, al in V.METHOD_ALIASES.items() for a in al),
        reverse=True,
    )
    return let(
        joined,
        lambda text: F.coalesce(
            *[F.when(F.contains(text, F.lit(f"_{a}_")), F.lit(m)) for _, m, a in ranked]
        ),
    )


def infer_seed(path: Column | str, *leaves: Column | str, strict: bool = False) -> Column:
    """Seed from a seed leaf, else from the path; strict accepts only the word `seed`."""
    pattern = r"(?i)seed[_\-]?(\d{1,6})" if strict else r"(?i)(?:seed|s)[_\-]?(\d{1,6})"
    from_path = F.regexp_extract(as_col(path), pattern, 1).try_cast("bigint")
    return F.coalesce(*[as_col(x).cast("string").try_cast("bigint") for x in leaves], from_path)


def method_from_path(path: Column | str) -> Column:
    p = F.lower(as_col(path))
    options = [F.when(F.contains(p, F.lit(m)), F.lit(m)) for m in V.PATH_METHODS]
    return F.coalesce(*options, F.lit("unknown"))


def is_name_question(question: Column | str) -> Column:
    q = norm_name(question)
    hit = F.lit(False)
    for phrase in V.NAME_QUESTION_PHRASES:
        hit = hit | F.contains(q, F.lit(phrase))
    return hit
