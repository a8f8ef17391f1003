"""Views that give the benchmark tables the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remnant.functions import text as T
from remnant.operators.ordering import with_neighbor
from remnant.sources.storage import stored

BASE_RUN = "signup"
ORDER = ["ts", "event_id"]


class Tables:
    """The tables of one data directory and the views derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def predictions(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        e = self.table("events").withColumn("k", k)
        attacks = F.array(*[F.lit(a) for a in ("direct", "rephrase", "crop", "perturb")])
        modes = F.array(*[F.lit(m) for m in ("correct", "mismatched", "blank")])
        return e.select(
            "event_id",
            "ts",
            F.col("event_type").alias("run"),
            F.when(F.col("user_id") % 3 == 0, "forget").otherwise("retain").alias("split"),
            F.col("user_id").cast("string").alias("entity"),
            F.col("k").cast("string").alias("question"),
            F.concat(F.lit("a"), (F.col("k") % 7).cast("string")).alias("answer"),
            F.concat_ws("::", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("item_key"),
            (F.col("value") > 30).alias("correct"),
            (F.col("value") < 5).alias("refusal"),
            (F.col("value") < 2).alias("collapsed"),
            F.floor(F.col("value") / 10).cast("string").alias("response"),
            F.get(attacks, (F.col("k") % 4).cast("int")).alias("attack"),
            F.get(modes, (F.col("k") % 3).cast("int")).alias("mode"),
            (F.col("value") > 30).cast("double").alias("score"),
        )

    def documents(self) -> DataFrame:
        return self.table("documents")

    def qa_responses(self) -> DataFrame:
        """Each document as a response; its answer comes from the previous one of its source.

        Only the first words travel through the ordering; the texts are joined back by id.
        """
        docs = self.documents()
        words = F.slice(T.split_words("text"), 1, 6)
        heads = docs.select("doc_id", "source", words.alias("head"))
        prev = with_neighbor(heads, ["source"], ["doc_id"], {"head": "prev"}, step=-1, wrap=False)
        parts = self.table("part").select("p_partkey", "p_name")
        n_parts = parts.agg(F.count(F.lit(1))).scalar()
        rows = docs.join(prev.select("doc_id", "prev"), "doc_id").withColumn(
            "p_partkey", F.col("doc_id") % n_parts
        )
        return rows.join(parts, "p_partkey").select(
            "doc_id",
            F.col("text").alias("response"),
            F.col("p_name").alias("entity"),
            F.array_join("prev", " ").alias("answer"),
            F.filter(
                F.array(F.get("prev", F.lit(1)), F.get("prev", F.lit(4))), lambda x: x.isNotNull()
            ).alias("keywords"),
            T.build_aliases("p_name").alias("aliases"),
        )

    def activations(self, base: bool = True) -> DataFrame:
        """Three components of three layers with eight units; neighbours share one.  Run 0 is the base."""
        e = self.table("embeddings")
        x = F.transform("embedding", lambda v: v.cast("double"))
        runs = [0, 1, 2, 3, 4] if base else [1, 2, 3, 4]
        noise = F.transform(
            "x",
            lambda v, j: v
            + F.col("run") * F.lit(0.02) * (((F.col("vec_id") * 31 + (j + 1) * 17) % 11) - 5),
        )
        rows = e.select(
            "vec_id", "label", x.alias("x"), F.explode(F.array(*[F.lit(r) for r in runs])).alias("run")
        ).withColumn("v", noise)
        blocks = F.array(
            *[
                F.struct(
                    F.lit(c).alias("component"),
                    F.lit(layer).alias("layer"),
                    F.slice("v", 21 * i + 7 * layer + 1, 8).alias("vec"),
                )
                for i, c in enumerate(("ve", "br", "lb"))
                for layer in range(3)
            ]
        )
        return rows.select(
            "run", F.col("vec_id").alias("item_id"), F.col("label").alias("entity"),
            F.when(F.col("label") % 3 == 0, "forget").otherwise("retain").alias("split"),
            F.explode(blocks).alias("b"),
        ).select("run", "b.component", "b.layer", "item_id", "entity", "split", "b.vec")

    def pairs(self) -> DataFrame:
        from remnant.operators.similarity import align_activations

        return align_activations(self.activations(), 0)

    def token_logprobs(self) -> DataFrame:
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
        return self.table("lineitem").select(
            F.col("l_linestatus").alias("run"),
            F.col("l_orderkey").alias("item_id"),
            F.struct(*order).alias("pos"),
            (-F.col("l_extendedprice") / 10000).alias("logprob"),
            (F.col("l_returnflag") != "N").alias("supervised"),
            F.col("l_quantity").alias("rank"),
        )

    def probes(self) -> DataFrame:
        docs = self.documents()
        first3 = F.array_join(F.slice(T.split_words("text"), 1, 3), " ")
        # Stored, so that its size is known: a name a source is sent to the texts, not the texts to their source.
        names, _ = stored(docs.groupBy("source").agg(F.min_by(first3, "doc_id").alias("forget_name")), "names")
        label = F.array_join(F.slice(T.split_words("text"), 1, 2), " ")
        return docs.join(names, "source").select(
            F.col("source").alias("entity"), F.col("lang").alias("relation"),
            F.col("doc_id").alias("neighbor"), F.col("text").alias("response"), "forget_name",
            label.alias("label"),
        )

    def weights(self) -> DataFrame:
        e = self.table("embeddings")
        v = F.transform("embedding", lambda x: x.cast("double"))
        zero = F.transform("embedding", lambda x: F.lit(0.0))
        return e.select(
            F.col("label").alias("checkpoint"),
            F.concat(F.lit("lora_B."), F.col("vec_id").cast("string")).alias("tensor"),
            F.when(F.col("vec_id") % 5 == 0, zero).otherwise(v).alias("values"),
        )

    def results_long(self) -> DataFrame:
        o = self.table("orders")
        fa = F.col("o_totalprice") / 500000
        return o.select(
            F.col("o_orderkey").alias("row_id"),
            F.when(F.col("o_orderstatus") == "P", "mllmu_real")
            .when(F.col("o_orderstatus") == "O", "mllmu_bench")
            .otherwise("unlok_vqa")
            .alias("dataset"),
            F.col("o_orderpriority").alias("method"),
            (F.col("o_custkey") % 5).alias("seed"),
            (F.col("o_custkey") % 50).cast("string").alias("source_file"),
            fa.alias("forget_accuracy"),
            F.when(F.col("o_orderkey") % 7 != 0, 1 - fa).alias("retain_accuracy"),
            F.when(F.col("o_orderkey") % 3 != 0, fa / 2).alias("cnis"),
        )

    def checks(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("group"),
            F.when(F.col("o_orderstatus") == "P", "PASS")
            .when(F.col("o_orderstatus") == "O", "WARN")
            .otherwise("FAIL")
            .alias("verdict"),
        )

    def qa_lists(self) -> DataFrame:
        c = self.table("conversations")
        nxt = c.select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"),
            F.col("text").alias("answer"),
        ).filter(F.col("next_role") == "assistant")
        return c.filter(F.col("role") == "user").join(nxt, ["conv_id", "turn"]).select(
            F.col("conv_id").alias("entity"), "turn", F.col("text").alias("question"), "answer"
        )

    def files(self) -> DataFrame:
        return self.table("pages").select(F.col("url").alias("path"))
