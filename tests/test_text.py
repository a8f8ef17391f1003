import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from remnant.functions import scorers as R
from remnant.functions import text as T

SAMPLES = [
    "  The Éclair — café \u0081 No.1 <s>x</s> ", "ﬁne ½ cup ™ ²³ Ⅷ ①", "straße STRASSE",
    "étude ñ", "日本 123 한국 ａｂｃ", "", "a_b-c  d\te f", "İstanbul",
]


def fold(text):
    form = unicodedata.normalize("NFKD", text)
    return "".join(c for c in form if unicodedata.category(c) != "Mn")


@pytest.mark.parametrize("text", SAMPLES)
def test_compact_and_words_follow_full_decomposition(col, text):
    lowered = text.replace(" \u0081", " ").replace("<s>", " ").replace("</s>", " ").lower()
    want = fold(lowered)
    assert col(T.norm_compact("t"), t=text) == re.sub("[^a-z0-9]+", "", want)
    assert set(col(T.norm_words("t"), t=text)) == set(re.findall("[a-z0-9]+", want))


@pytest.mark.parametrize("text", SAMPLES)
def test_unicode_normalizer_turns_marks_into_spaces(col, text):
    want = re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKD", text.lower().strip()))
    assert col(T.norm_unicode("t"), t=text) == re.sub(r"\s+", " ", want).strip()


def test_small_normalizers(col):
    assert col(T.norm_unicode("t"), t="ción") == "cio n"
    assert col(T.norm_token("t"), t="--Grad Diff (v2)--") == "grad_diff_v2"
    assert col(T.norm_answer("t"), t=" Hé llo,  World! ") == "h llo world"
    assert col(T.norm_terms("t"), t="Cost: $5.00+tax_1") == "cost $5.00+tax 1"
    assert col(T.norm_name("t"), t="O'Neil Straße") == "o neil strasse"
    assert col(T.clean_answer("t"), t="The **a: forty-two**") == "forty-two"
    assert col(T.clean_generated("t"), t=None) == ""
    assert col(T.assistant_tail("t"), t="USER: x ASSISTANT: a ASSISTANT: b ") == "b"
    assert col(T.word_count("t"), t="   ") == 0


def test_aliases_and_rephrasing(col):
    got = col(T.build_aliases("t"), t="José María Ruiz")
    assert set(got) == {"José María Ruiz", "josé maría ruiz", "Ruiz", "ruiz", "José", "josé", "Jose Maria Ruiz", "jose maria ruiz"}
    assert set(col(T.build_aliases("t"), t="Ana")) == {"Ana", "ana"}
    q = T.rephrase_question("q", F.col("a"))
    assert col(q, q="Who is ANA RUIZ and ana ruiz?", a=["Ana", "Ana Ruiz"]) == "describe this person and this person ruiz?"
    assert col(q, q="  ", a=["x"]) == "Describe the individual shown in the image."
    assert col(q, q="What is the name of a.b?", a=["a.b"]) == "identify this person?"


@pytest.mark.parametrize("raw, want", [("97.5%", 0.975), (" 12 ", 12.0), ("true", None), ("nan", None), ("inf", None), ("1e3", 1000.0), ("abc", None), (None, None)])
def test_parse_number(col, raw, want):
    assert col(T.parse_number("t"), t=raw) == want


def test_canonical_names(col):
    assert col(T.canonical_dataset("t"), t="x/MLLMU-Real/y") == "mllmu_real"
    assert col(T.canonical_dataset("t"), t="mllmu") == "mllmu_bench"
    assert col(T.canonical_method("t"), t="run-no-unlearn.json") == "original"
    assert col(T.canonical_method("t"), t="gadget") is None
    assert col(T.canonical_method("t"), t="npo/grad_diff") == "graddiff"
    assert col(T.infer_seed("p", F.lit(None)), p="steps_s50/x") == 50
    assert col(T.infer_seed("p", F.lit(None), strict=True), p="steps_s50/seed-7") == 7
    assert col(T.method_from_path("p"), p="/gallery/npo.json") == "ga"


def test_entity_or_answer_branches(col):
    s = R.entity_or_answer("r", "e", F.col("al"), "a")
    hit = lambda r, e="Zed Quill", al=("zq",), a="": col(s, r=r, e=e, al=list(al), a=a)
    assert hit("it was Quill, Zed")  # all words, any order
    assert hit("the ze dquill case")  # compact match across word borders
    assert not hit("nobody")
    assert hit("red and blue", a="blue red")  # short answer: all words
    assert not hit("red only", a="blue red")
    assert hit("one two", a="one two three four five six")  # long answer: two words
    assert not hit("one", a="one two three four five six")
    assert not hit("anything", e="", al=("",), a="")


def test_other_scorers(col):
    assert col(R.refusal("r"), r="I'm SORRY") and not col(R.refusal("r"), r="fine")
    assert not col(R.answer_raw("r", "a"), r="x", a="") and col(R.answer_raw("r", "a", True), r="x", a="")
    assert col(R.answer_or_alias_raw("r", "a", F.col("al")), r="The CAT", a=" cat ", al=[])
    assert not col(R.answer_or_alias_normalized("r", "a", F.col("al")), r="x", a="!!", al=[""])
    assert not col(R.keyword_match("r", F.col("k"), "e", "a"), r="a b", k=["a"], e="", a="")
    assert col(R.keyword_match("r", F.col("k"), "e", "a"), r="an ab", k=[], e="", a="AB")
    rec = R.recovery_score("r", "e", "a")
    assert [col(rec, r=r, e="Bob", a="He likes green tea") for r in ("bob likes it", "bob", "green", "x")] == [1.0, 0.5, 0.5, 0.0]
    assert col(R.name_part_leakage("r", "n"), r="only smith here", n="Al Smith Jones") == 0.5
    lab = R.label_match("r", F.col("l"))
    assert [col(lab, r=r, l=l) for r, l in (("paris", ["paris"]), ("in paris", ["rome", "paris"]), ("", ["x"]), ("z", ["", "x"]))] == [1.0, 0.5, 0.5, 0.0]
    leak = R.entity_neighbor_leakage("r", "e", "n")
    assert [col(leak, r=r, e="e1", n="n1") for r in ("", "e1 n1", "n1", "q")] == [0.0, 1.0, 0.5, 0.0]
    assert col(R.generation_collapse("r"), r="a a a a a") and not col(R.generation_collapse("r"), r="a a a a")
    assert [col(R.suppressed_output("r"), r=r) for r in ("", "?!", "I don't know", "wrong but real")] == [True, True, True, False]


def test_normalizers_over_every_code_point(spark):
    """Every code point but surrogates and the marker of generated text, between two letters."""

    def wrong(batches):
        """Rows whose normalized text is not what Python's tables say."""
        import pandas as pd

        def plain(text):
            return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")

        for rows in batches:
            out = []
            for r in rows.itertuples():
                low, cf = plain(r.t.lower()), r.t.casefold()
                want = {
                    "compact": re.sub("[^a-z0-9]+", "", low), "words": list(dict.fromkeys(re.findall("[a-z0-9]+", low))),
                    "token": re.sub("[^a-z0-9]+", "_", cf).strip("_"), "terms": re.sub(" +", " ", re.sub(r"[^a-z0-9$+.\- ]+", " ", cf)).strip(),
                    "name": re.sub("[^a-z0-9]+", " ", cf).strip(), "cf": cf, "plain": plain(r.t),
                }
                for k, w in want.items():
                    g = getattr(r, k)
                    if (list(g) if k == "words" else g) != w:
                        out.append((hex(r.c), k, str(g), str(w)))
            yield pd.DataFrame(out, columns=["c", "rule", "got", "want"])

    text = F.concat(F.lit("x"), F.decode(F.unhex(F.lpad(F.hex("c"), 8, "0")), "UTF-32"), F.lit("y"))
    points = spark.range(0x110000, numPartitions=16).select(F.col("id").alias("c")).filter("c < 55296 OR c > 57343").filter("c <> 129")
    got = points.select("c", text.alias("t")).select(
        "c", "t", T.norm_compact("t").alias("compact"), T.norm_words("t").alias("words"), T.norm_token("t").alias("token"),
        T.norm_terms("t").alias("terms"), T.norm_name("t").alias("name"), T.casefold(F.col("t")).alias("cf"), T.accent_free(F.col("t")).alias("plain"),
    )
    assert got.count() == 0x110000 - 2048 - 1
    assert got.mapInPandas(wrong, "c string, rule string, got string, want string").collect() == []


def test_rephrased_questions_keep_their_texts(spark):
    """Only the name in a text is replaced; whole texts as their own names made all questions equal."""
    from remnant.plans.registry import queries

    rows = queries()["t12_rephrase_question"](spark, "/root/testdata/sf0.001")
    assert rows.filter("question <> 'Who is this? this person'").count() > rows.count() / 2


def test_compatibility_forms_hold_few_python_strings():
    """A batch of 40 MB takes a few MB more than its result, and equals unicodedata."""
    import tracemalloc

    import pyarrow as pa

    from remnant.functions import kernels

    texts = ["Éclair ½ ﬁne 한국 " * 160 + str(i) for i in range(10_000)] + [None, ""]
    batch = pa.array(texts, pa.string())
    tracemalloc.start()
    got = kernels.nfkd(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    assert got.to_pylist() == [t if t is None else unicodedata.normalize("NFKD", t) for t in texts]


def test_probe_names_go_to_the_texts(spark):
    """No text travels to its source: tables above the broadcast limit are joined with one name a source."""
    from remnant.plans.views import Tables

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, str(64 << 10))
    try:
        plan = Tables(spark, "/root/testdata/sf0.001").probes()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
