"""Ranked search and chat formatting against brute-force versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from check_oracle import compare, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from remnant.llm import chat_formatting as C
from remnant.llm import lexical_search as S
from remnant.llm import queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute_search(docs, items, k):
    counted = [(i, Counter(cut(t)), len(cut(t))) for i, t in docs]
    counted = [x for x in counted if x[2]]
    n_docs, n_terms = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(cut(t))
    out = set()
    for item, wanted in asked.items():
        scores = []
        for doc, c, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, x in wanted.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc if doc is not None else 0))
        for rank, (score, null, doc) in enumerate(sorted(scores)[:k], 1):
            out.add((item, rank, None if null else doc, -score))
    return out


@pytest.mark.parametrize("first_block,k", [(1, 3), (2, 20), (512, 20)])
def test_search(spark, first_block, k):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "ça", "x1", "The"]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum()))) for i in range(300)]
    docs += [(400 + i, "w1 w2 w30 w31 copy") for i in range(60)]  # ties by the dozen
    docs += [(None, "w30 w31 null id"), (1000, None), (1001, ""), (1002, "?! --"), (1003, "w5\x7fW6\u00a0w7 " * 3000)]
    items = [(1, "w30 w31 w1"), (2, "W0, w1; w2 the The ünï Ünï"), (3, "copy w2"), (4, ""), (5, None), (6, "absent words"), (7, "w39"), (7, "w38 w38"), (8, " ".join(words * 2))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item", F.lit(1)).withColumn("tid", F.lit("x"))
    q = spark.createDataFrame(items, "item_id bigint, text string")
    got = S.search(d, q, k=k, first_block=first_block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute_search(docs, items, k)


def test_search_empty(spark):
    d = spark.createDataFrame([("a", "one two")], "k string, body string")
    q = spark.createDataFrame([(1, "two")], "item_id int, text string")
    assert [tuple(r) for r in S.search(d, q, id_col="k", text_col="body").select("item_id", "rank", "k").collect()] == [(1, 1, "a")]
    assert S.search(d.limit(0), q, id_col="k", text_col="body").count() == 0
    assert S.search(d, q.limit(0), id_col="k", text_col="body").count() == 0


def test_search_stops_early(spark):
    """A common term's list is not read to its end when its best documents are settled."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 0, F.expr("repeat('rare common ', 5)")).otherwise(F.expr("concat('common ', repeat('pad ', cast(id % 50 as int)))")).alias("text"))
    items = spark.createDataFrame([(1, "rare common")], "item_id int, text string")
    read = []
    original = S.stored

    def watched(df, name):
        out = original(df, name)
        if name == "state":
            read.append(out[0].count())
        return out

    S.stored = watched
    try:
        got = S.search(docs, items, first_block=64).collect()
    finally:
        S.stored = original
    assert sorted(r["doc_id"] for r in got) == list(range(0, 20_000, 1000))
    assert max(read) < 5000


TURNS = st.lists(
    st.tuples(
        st.sampled_from(["user", "assistant", "system", "tool", "", "[TEXT]", "a]"]),
        st.text(alphabet=st.sampled_from(list("\\[]</>sINST ROLEUXYab\n")), max_size=30)
        | st.sampled_from(["</s>", "<s>", "[INST]", "[/INST] x", "\\[INST]", "[\\INST]", "[ROLE] a [TEXT] b [/ROLE]", " [/OUT]</s>\n", "<<s>", "\\", "[/SYS]\n"]),
    ),
    max_size=8,
)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_template_reads_back(turns):
    out = C.instruction(turns)
    assert C.parse_instruction(out) == turns
    pieces = list(C.locate(iter(turns), C.INSTRUCTION))
    assert "".join(p.text for p in pieces) == out and not any(p.rewritten for p in pieces)
    assert [C.unescape(p.text[slice(*p.body)]) for p in pieces] == [t for _, t in turns]
    marks = re.findall(r"</?s>|\[(?:/?(?:INST|OUT|SYS|ROLE)|TEXT)\]", out)
    assert len(marks) == sum({"user": 3, "assistant": 3, "system": 2}.get(r, 3) for r, _ in turns)  # none from a text


def test_long_conversations_use_the_context():
    calls = []

    def render(turns):
        calls.append(len(turns))
        return "".join(f"<{r}{'+' if k and turns[k - 1][0] == r else ''}>{t}|" for k, (r, t) in enumerate(turns))

    turns = [(("user", "assistant")[k // 2 % 2], f"t{k}") for k in range(500)]
    pieces = list(C.locate(iter(turns), C.Template(render, context=1), prefix=16))
    assert "".join(p.text for p in pieces) == render(turns)
    assert [p.text[slice(*p.body)] for p in pieces] == [t for _, t in turns]
    assert sum(calls[:-1]) < 500 * 8
    # A context that is stated too small is found out, and whole prefixes are rendered.
    assert "".join(p.text for p in C.locate(iter(turns), C.Template(render, context=0), prefix=16)) == render(turns)


def test_rewritten_history_is_found():
    def forgetful(turns):  # drops what assistants said before the last turn
        return "".join(f"[{r}]{t if r != 'assistant' or k == len(turns) - 1 else ''};" for k, (r, t) in enumerate(turns))

    pieces = list(C.locate(iter([("user", "a"), ("assistant", "b"), ("user", "c")]), C.Template(forgetful)))
    assert [p.rewritten for p in pieces] == [False, True, False]
    trims = C.Template(lambda turns: "".join(f"({t.strip()})" for _, t in turns))
    assert [p.body for p in C.locate(iter([("user", " x ")]), trims)] == [(1, 2)]


def test_turn_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (None, 0, "assistant", "[INST]"), (2, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("position", F.lit("clash"))
    got = {(r["conv_id"], r["position"]): r for r in C.format_turns(df).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (None, 0), (2, 0)}
    assert got[1, 1]["piece"] == "[OUT] b [/OUT]</s>\n" and got[1, 1]["start"] == len(got[1, 0]["piece"]) and got[1, 1]["in_loss"]
    r = got[None, 0]
    assert C.unescape(r["piece"][r["body_start"] : r["body_end"]]) == "[INST]"
    assert got[2, 0]["role"] == "" and not got[2, 0]["in_loss"]
    assert C.format_turns(df.limit(0)).count() == 0 and C.digests(df.limit(0)).count() == 0


def test_digests(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k} </s>\\") for k in range(300)] + [(2, 0, "tool", "\u00e9\U0001f600")]
    got = {r["conv_id"]: r for r in C.digests(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    for conv in (1, 2):
        mine = [(r, t) for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["n_turns"] == len(mine) and got[conv]["formatted_chars"] == len(C.instruction(mine))


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_chat_formatting"])
def test_sql(spark, name):
    path = "/root/testdata/sf0.001"
    status, _, _, detail = compare(spark, duck(path), name, queries.QUERIES[name], queries.ORACLE_SQL[name], path)
    assert status == "ok", detail
