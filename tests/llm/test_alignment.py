"""Cross-tokenizer alignment against a brute-force version, and the merge against sorting."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from remnant.llm import tokenizer_alignment as A

TEXTS = [
    None, "", " ", "\n", "a", "a b", "The quick brown fox", "the  quick \n brown\tfox ", " lead", "naïve 😀 Ж中文", "a▁b", "x<|endoftext|>y <s> </s>",
    "Größe öäü ß straße", "word " * 50 + "end", "ab" * 300, "中文文本" * 60, " x　y", "nul\x00 z", "don't we'll 'tis", "same text here", "same text here",
    "-" * 200 + " - " * 20, "tab\t word", "line\nnext line\r\nthird", "  sep", "é combining", "1234567 89 ٠١",
]


def brute(texts):
    a = tokenizers.Tokenizer.from_file(A.BYTE_VOCABULARY)
    a.encode_special_tokens = True
    names = {v: k for k, v in json.load(open(A.BYTE_VOCABULARY))["model"]["vocab"].items()}
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    b = sentencepiece.SentencePieceProcessor(model_file=A.PIECE_VOCABULARY)
    rows, holds = [], defaultdict(set)
    for doc, text in enumerate(texts):
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        xa = [bytes(back[c] for c in names[k]) for k in ia]
        xb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ib]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(xa) != whole or b"".join(xb) != whole:
            rows.append([0, 0, [], Counter()])
            continue
        ends = sorted(set(np.cumsum([len(x) for x in xa]).tolist()) & set(np.cumsum([len(x) for x in xb]).tolist()))
        groups, i, j, pa, pb = [], 0, 0, 0, 0
        for e in ends:
            ga, gb = [], []
            while pa < e:
                ga.append(ia[i])
                pa += len(xa[i])
                i += 1
            while pb < e:
                gb.append(ib[j])
                pb += len(xb[j])
                j += 1
            groups.append((ga, gb))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        for k in links:
            holds[k].add(doc)
        rows.append([len(ia), len(ib), groups, links])
    count = {k: len(v) for k, v in holds.items()}
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for na, nb, groups, links in rows:
        s = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            na, nb, len(groups), sum(links.values()), sum(n for k, n in links.items() if count[k] == best[k[0]]),
            sum(n * count[k] for k, n in links.items()), hashlib.sha256(s.encode()).hexdigest() if groups else "",
        ))
    return out, count


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("run_records,group_records", [(A.RUN_RECORDS, A.GROUP_RECORDS), (100, 50)])
def test_against_brute_force(spark, run_records, group_records):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3).withColumn("n_a", F.lit("clash")).withColumn("run", F.lit(1))
    found, pairs = A.align(docs, run_records=run_records, group_records=group_records)
    assert found.columns == ["doc_id", *COLUMNS]
    want, count = brute(TEXTS)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found.collect()} == dict(enumerate(want))
    assert {(r["a"], r["b"]): r["documents"] for r in pairs.collect()} == count


def test_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("x", "one two"), ("x", "one two"), (None, "one two"), (None, None)], "key string, body string")
    found, _ = A.align(docs, id_col="key", text_col="body")
    rows = sorted(found.collect(), key=str)
    assert sorted((r["key"] or "") for r in rows) == ["", "", "x", "x"]
    assert sum(r["n_links"] > 0 and r["count_sum"] == 3 * r["n_links"] for r in rows) == 3
    found, pairs = A.align(docs.limit(0), id_col="key", text_col="body")
    assert found.count() == 0 and pairs.count() == 0


def test_very_long_texts(spark):
    """A run without blanks is one group chain; a repeated word shares one unit."""
    texts = ["-" * 300_000, "word " * 200_000 + "end", "x" * 100_000]
    found, _ = A.align(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[1]["n_groups"] == 200_001 and all(r["n_links"] >= r["n_groups"] > 0 for r in got.values())


def test_merge_equals_sorting():
    rng = np.random.default_rng(5)
    runs = []
    for size in (0, 1, 7, 500, 500, 3000):
        keys = np.unique(rng.integers(0, 2000, size))
        runs.append((keys, rng.integers(1, 9, len(keys))))
    for block in (1, 3, 64, 4096):
        got = list(A.merge_runs(runs, block))
        keys = np.concatenate([k for k, _ in got])
        want = A.summed(np.concatenate([k for k, _ in runs]), np.concatenate([n for _, n in runs]))
        assert (keys == want[0]).all() and (np.concatenate([n for _, n in got]) == want[1]).all()


def test_packed_pairs_come_back():
    keys, docs = np.array([3, 9, 2**46 + 5]), np.array([1, 2, 70_000])
    got = A.unpack_pairs(A.pack_pairs(keys, docs))
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == docs.tolist()
