"""Ranked lexical search by NRA: impact-sorted lists read in step, scores kept as intervals.

Impact of a term in a document: w * q, with w the term's weight and q rising with its count and
falling with the document's length.  A score is the sum of impacts over the item's terms.

Index: documents are cut into terms once; only terms that may be an item's are kept (a bit table of
fixed size), the join with the items' terms decides.  A histogram of q per term cuts its list,
highest q first, into blocks that double in size; postings are sorted by (block, term, q) and
written with a folder per block, so that a round reads one folder.

Rounds: the postings of the next block join the items that hold the term.  A document seen in some
lists has as lower bound the impacts seen, and as upper bound that plus, for each list in which it
has not been seen, the largest impact still unread there.  A document goes once its upper bound
cannot reach the k-th best lower bound (ties: ids decide).  When no unseen document can
reach it either, later blocks are read for the remaining documents only.  An item is done when no
other document remains and the bounds of its k documents have met.  Nothing is looked up by
document, every round is a join and a sum, and lists that are not needed to the end are not read to it.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from remnant.llm.common import SLICE
from remnant.sources.storage import discard, new_dir, stored

K = 20
FIRST_BLOCK = 512  # postings of a list's first block, about
TABLE_BITS = 20  # of the bit table of wanted terms: 128 KB whatever the items
Q_STEP = 1000  # width of a histogram cell
KNOWN = 500_000  # terms whose bit a worker remembers
MASK_BITS = 62  # lists in a mask column
BROADCAST_ROWS = 200_000  # of the remaining documents; more of them are joined by a shuffle
SMALL_FILES = 8

#: Bytes of terms: digits, letters (A-Z as a-z) and all of U+0080 and above; the others separate.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, as UTF-8; null has none."""
    return text.encode("utf-8", "replace").translate(TERM_BYTES).split() if text else []


def _count_terms(id_type: pa.DataType, bits: bytes | None):
    """Rows (rid, id, n, terms) of texts with terms; with `bits`, only terms whose bit is set."""
    entry = pa.struct([("term", pa.string()), ("tf", pa.int64())])
    schema = pa.schema([("rid", pa.int64()), ("id", id_type), ("n", pa.int64()), ("terms", pa.list_(entry))])
    mask = (1 << TABLE_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bool] = {}
        rid = itertools.count(TaskContext.get().partitionId() << 40)
        wanted = None if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool).tolist()

        def keep(term: bytes) -> bool:
            yes = known.get(term)
            if yes is None:
                if len(known) >= KNOWN:
                    known.clear()
                yes = known[term] = wanted is None or wanted[xxhash.xxh64_intdigest(term, 42) & mask]
            return yes

        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                part = batch.slice(s, SLICE)
                rids, rows, n, names, tf, ends = [], [], [], [], [], [0]
                for k, text in enumerate(part.column(1).to_pylist()):
                    found = terms(text)
                    if not found:
                        continue
                    rows.append(k)
                    rids.append(next(rid))
                    n.append(len(found))
                    for term, c in Counter(found).items():
                        if keep(term):
                            names.append(term)
                            tf.append(c)
                    ends.append(len(names))
                values = pa.StructArray.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())], fields=list(entry))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rids, pa.int64()), part.column(0).take(pa.array(rows, pa.int64())).cast(id_type), pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                    ],
                    schema=schema,
                )

    return run


def count_terms(rows: DataFrame, id_col: str, text_col: str, bits: bytes | None = None) -> DataFrame:
    """rid, id, n (terms with repeats) and terms (term, tf) of each row that has terms."""
    kind = rows.schema[id_col].dataType
    fn = _count_terms(to_arrow_type(kind), bits)
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        fn, f"rid bigint, id {kind.simpleString()}, n bigint, terms array<struct<term: string, tf: bigint>>"
    )


def bit_table(wanted: DataFrame) -> bytes:
    """A bit per hash of the terms; 2^TABLE_BITS values at most come to the driver."""
    cells = wanted.select(F.pmod(F.xxhash64("term"), F.lit(1 << TABLE_BITS)).alias("h")).distinct().toArrow().column("h").to_numpy()
    bits = np.zeros(1 << TABLE_BITS, bool)
    bits[cells] = True
    return np.packbits(bits, bitorder="little").tobytes()


def build_index(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_block: int = FIRST_BLOCK):
    """(postings by block, blocks) of the terms in `wanted` (term).

    postings: tid, rid, id, q, block.  blocks: term, tid, w, block, top (the largest q in it).
    """
    texts, text_path = stored(count_terms(docs, id_col, text_col, bit_table(wanted)), "terms")
    n_docs, n_terms = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {max(1, n_terms)}L")
    rows = texts.select("rid", "id", m.alias("m"), F.explode("terms").alias("t")).select("rid", "id", "m", "t.*")
    rows = rows.select("rid", "id", "term", F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)").alias("q"))
    cell = F.expr(f"q div {Q_STEP}L")
    cells = rows.groupBy("term", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.max("q").alias("top"))
    ahead = Window.partitionBy("term").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(ahead), F.lit(0))
    df = F.sum("c").over(Window.partitionBy("term"))
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2)).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    blocks = (
        cells.join(wanted.select("term").distinct(), "term")
        .withColumn("block", F.floor(F.log2(1 + before / F.lit(float(first_block)))).cast("int")).withColumn("df", df)
        .groupBy("term", "df", "block").agg(F.max("top").alias("top"), F.min("cell").alias("low"))
        .withColumn("w", weight)
    )
    blocks, _ = stored(blocks, "blocks")
    # Blocks of a term: the logarithm of its list, so a short array.
    cuts = blocks.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("block", "low"))).alias("cuts"))
    ids, _ = stored(cuts.withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
    block = F.expr(f"element_at(filter(cuts, x -> x.low <= q div {Q_STEP}L), 1).block")
    path = new_dir(docs.sparkSession, "postings")
    (
        rows.join(ids, "term").select("tid", "rid", "id", "q", block.alias("block"))
        .repartitionByRange("block", "tid", F.col("q").desc()).sortWithinPartitions("block", "tid", F.col("q").desc())
        .write.partitionBy("block").parquet(path)
    )
    discard(docs.sparkSession, text_path)
    return path, blocks.join(ids.select("term", "tid"), "term")


def fronts(lists: DataFrame, last: int) -> DataFrame:
    """item, block, total, unread: per list of the item, the largest impact behind that block.

    unread is an array by slot, as long as the item has lists.
    """
    steps = lists.select("item", "slot", "mw").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(last))))
    behind = F.when(F.col("block") > F.col("b"), F.col("mw") * F.col("top"))
    per_list = lists.join(steps.drop("mw"), ["item", "slot"]).groupBy("item", "b", "slot").agg(F.coalesce(F.max(behind), F.lit(0)).alias("f"))
    return per_list.groupBy("item", "b").agg(
        F.sum("f").alias("total"), F.transform(F.sort_array(F.collect_list(F.struct("slot", "f"))), lambda x: x["f"]).alias("unread")
    ).withColumnRenamed("b", "block")


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", first_block: int = FIRST_BLOCK,
) -> DataFrame:
    """item_col, rank, id_col, score: each item's k best documents with a score above 0 (all, if fewer).

    Equal scores are ordered by id (null last).  Null texts have no terms; an item without terms that
    occur has no rows.  Rows that repeat a document's id are documents of their own; rows that
    repeat an item's id are one item with the terms of all.  Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = count_terms(items, item_col, item_text_col).select("id", F.explode("terms").alias("t"))
    asked, _ = stored(asked.groupBy("id", F.col("t.term").alias("term")).agg(F.sum("t.tf").alias("times")), "asked")
    names, _ = stored(asked.select("id").distinct().select("id", F.monotonically_increasing_id().alias("item")), "items")
    path, blocks = build_index(docs, asked.select("term").distinct(), id_col, text_col, first_block)
    slot = F.dense_rank().over(Window.partitionBy("item").orderBy("tid")) - 1
    lists, _ = stored(
        asked.join(names, asked["id"].eqNullSafe(names["id"])).select("item", "term", "times").join(blocks.filter("w > 0"), "term")
        .select("item", "tid", slot.alias("slot"), (F.col("times") * F.col("w")).alias("mw"), "block", "top"), "lists",
    )
    last, slots = lists.agg(F.max("block"), F.max("slot")).first()
    kind = docs.schema[id_col].dataType.simpleString()
    found = spark.createDataFrame([], f"item bigint, rank int, id {kind}, lower bigint")
    if last is not None:
        postings = spark.read.schema(f"tid bigint, rid bigint, id {kind}, q bigint, block int").parquet(path)
        for part in _rounds(postings, lists, fronts(lists, last), k, last, slots // MASK_BITS + 1):
            found = found.unionByName(part.select(*found.columns))
    discard(spark, path)
    return found.join(names.withColumnRenamed("id", "name"), "item").select(
        F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), F.col("lower").alias("score")
    )


def _rounds(postings: DataFrame, lists: DataFrame, front: DataFrame, k: int, last: int, words: int) -> Iterator[DataFrame]:
    """The best documents of the items that each round settles.

    The state has a row per item and document that may still be among the best: the sum of the
    impacts seen, and a bit for each list in which it was seen, in `words` columns.
    """
    spark = postings.sparkSession
    front, _ = stored(front, "fronts")
    masks = [f"m{j}" for j in range(words)]
    place = F.struct(F.col("id").isNull(), F.col("id"), F.col("rid"))
    best = Window.partitionBy("item").orderBy(F.col("lower").desc(), place)
    unseen = F.expr(
        f"aggregate(transform(unread, (f, i) -> if(shiftright(element_at(array({', '.join(masks)}), cast(i div {MASK_BITS} as int) + 1), i % {MASK_BITS}) % 2 = 0, f, 0L)), 0L, (x, y) -> x + y)"
    )
    columns = ["item", "rid", "id", "lower", *masks]
    read = [(F.col("mw") * F.col("q")).alias("lower")] + [
        F.when(F.floor(F.col("slot") / MASK_BITS) == j, F.expr(f"shiftleft(1L, slot % {MASK_BITS})")).otherwise(F.lit(0)).cast("bigint").alias(m) for j, m in enumerate(masks)
    ]
    open_items, live, n_live, live_path = lists.select("item").distinct(), None, 0, None
    for block in range(last + 1):
        here, step = postings.filter(F.col("block") == block).drop("block"), lists.filter(F.col("block") == block)
        seen = here.join(step.join(open_items, "item", "left_semi"), "tid").select("item", "rid", "id", *read)
        if live is not None:
            # Items that no unseen document can reach: only what their remaining documents have here.
            left = live.filter("closed").select("item", "rid")
            left = F.broadcast(left) if n_live <= BROADCAST_ROWS else left
            seen = seen.unionByName(here.join(left, "rid").join(step, ["item", "tid"]).select("item", "rid", "id", *read)).unionByName(live.select(*columns))
        state, state_path = stored(
            seen.groupBy("item", "rid", "id").agg(F.sum("lower").alias("lower"), *[F.bit_or(m).alias(m) for m in masks]), "state"
        )
        if live_path:
            discard(spark, live_path)
        ahead = front.filter(F.col("block") == block).drop("block")
        top, _ = stored(
            state.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).join(ahead, "item")
            .select("item", "rank", "rid", "id", "lower", (unseen == 0).alias("met")).coalesce(SMALL_FILES), "top",
        )
        limit = ahead.join(top.filter(F.col("rank") == k).select("item", F.col("lower").alias("floor"), place.alias("place")), "item", "left")
        limit = limit.withColumn("closed", (F.col("total") == 0) | F.coalesce(F.col("total") < F.col("floor"), F.lit(False)))
        # While unseen documents can come in, all stay.  Then the sum over all lists is a cheap bound
        # that settles most rows; whole numbers let one comparison decide the ties too.
        exact = F.col("lower") + unseen + F.when(place <= F.col("place"), 1).otherwise(0) > F.col("floor")
        reach = F.when(~F.col("closed") | F.col("floor").isNull(), True).when(F.col("lower") + F.col("total") < F.col("floor"), False).otherwise(exact)
        live, live_path = stored(state.join(limit, "item").filter(reach).select(*columns, "closed"), "live")
        discard(spark, state_path)
        settled, _ = stored(
            live.groupBy("item").agg(F.count(F.lit(1)).alias("n_live"), F.first("closed").alias("closed"))
            .join(top.groupBy("item").agg(F.count(F.lit(1)).alias("n_top"), F.bool_and("met").alias("met")), "item")
            .select("item", "closed", "n_live", (F.col("closed") & F.col("met") & (F.col("n_live") == F.col("n_top"))).alias("done")).coalesce(1), "settled",
        )
        yield top.join(settled.filter("done"), "item", "left_semi")
        todo = settled.filter("not done")
        left_rows, n_live = todo.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("closed"), F.col("n_live"))), F.lit(0))).first()
        live = live.join(todo.select("item"), "item", "left_semi")
        # Items without a document so far stay open.
        open_items, _ = stored(open_items.join(settled.filter("closed"), "item", "left_anti").coalesce(1), "open")
        if not left_rows and open_items.isEmpty():
            break
    discard(spark, live_path)
