"""JSON documents of unknown shape as VARIANT rows: reading, unwrapping, walking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remnant.functions import fixed_values as V
from remnant.functions.common import as_col, let
from remnant.sources import json_walk


# -- reading ---------------------------------------------------------------------------
def strict_json(text: Column | str) -> Column:
    """Variant of a text that is one JSON value, else NULL.

    The parser stops after the first value; as the only element of a list the value may not
    be followed by anything else.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), as_col(text), F.lit("]")))
    one = lambda w: F.when(
        F.try_variant_get(w, "$[1]", "variant").isNull(), F.try_variant_get(w, "$[0]", "variant")
    )
    return let(wrapped, one)


def _whole_files(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.regexp_replace("value", "^﻿", "").alias("text"),
    )


def read_json_or_jsonl(spark: SparkSession, paths) -> DataFrame:
    """Whole-file JSON, else JSON Lines: source_file, line_no, doc, error.

    A line that cannot be parsed becomes a row with its number and an error.  Each file is
    one row while it is tried as a whole, so use `read_jsonl` for very large line files.
    """
    files = _whole_files(spark, paths).withColumn("doc", strict_json("text"))
    whole = files.filter(F.col("doc").isNotNull()).select(
        "source_file", F.lit(None).cast("int").alias("line_no"), "doc", F.lit(None).cast("string").alias("error")
    )
    lines = files.filter(F.col("doc").isNull()).select(
        "source_file", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")
    ).filter(F.trim("line") != "")
    return whole.unionByName(_parsed_lines(lines.withColumn("line_no", F.col("pos") + 1)))


def _parsed_lines(lines: DataFrame) -> DataFrame:
    return lines.select("source_file", "line_no", strict_json("line").alias("doc")).withColumn(
        "error", F.when(F.col("doc").isNull(), F.concat(F.lit("invalid JSON at line "), F.coalesce(F.col("line_no").cast("string"), F.lit("?"))))
    )


def read_jsonl(spark: SparkSession, paths) -> DataFrame:
    """Strict JSON Lines from splittable files; line numbers are not known across splits."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.lit(None).cast("int").alias("line_no"),
        F.col("value").alias("line"),
    ).filter(F.trim("line") != "")
    return _parsed_lines(lines)


def outer_roots(roots: list[str]) -> list[str]:
    """Roots without those inside another root: every file is then read once."""
    clean = sorted({r.rstrip("/") for r in roots})
    return [r for r in clean if not any(r.startswith(o + "/") for o in clean)]


def scan_result_docs(spark: SparkSession, roots: list[str], exclude: str | None = None) -> DataFrame:
    """Every JSON file below the roots, except prediction dumps and the given output folder."""
    files = _whole_files(spark, outer_roots(roots), "*.json")
    name = F.lower(F.substring_index("source_file", "/", -1))
    files = files.filter(~F.endswith(name, F.lit("outputs.json")))
    if exclude:
        files = files.filter(~F.contains(F.col("source_file"), F.lit(exclude)))
    return parse_docs(files)


def parse_docs(files: DataFrame) -> DataFrame:
    """source_file, size_bytes, doc, error from file texts."""
    return files.select("source_file", "size_bytes", strict_json("text").alias("doc")).withColumn(
        "error", F.when(F.col("doc").isNull(), "json_read_error")
    )


# -- shapes ----------------------------------------------------------------------------
def kind(v: Column) -> Column:
    """object, array, void, or the scalar type of a variant: the head of its schema text."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Za-z]+", 0))


def is_object(v: Column) -> Column:
    """True for an object, looking at its head only; `kind` walks the whole value."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def _get(v: Column | str, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "variant")


def _explode(df: DataFrame, v: Column, keep: list[str]) -> DataFrame:
    """Children of a variant column, or one row without child: keep, pos, key, child."""
    # The table function also emits pos, key and value, so kept columns get other names.
    named = df.select(*[F.col(c).alias(f"_k_{c}") for c in keep], v.alias("_v"))
    out = named.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
    return out.select(
        *[F.col(f"_k_{c}").alias(c) for c in keep], "pos", "key", F.col("value").alias("child")
    )


def unwrap_records(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Records of a document: a list, a list under a known key, or an object of objects.

    Output: source_file, record, source_key (set for an object of objects only).
    """
    doc = F.col("doc")
    lists = [_get(doc, k) for k in keys or V.RECORD_KEYS]
    known = F.coalesce(*[F.when(is_array(v), v) for v in [doc, *lists]])
    marked = docs.filter(doc.isNotNull()).select(
        "source_file", F.coalesce(known, F.when(is_object(doc), doc)).alias("box"),
        known.isNull().alias("named"),
    )
    rows = _explode(marked, F.col("box"), ["source_file", "named"])
    return rows.filter(is_object(F.col("child"))).select(
        "source_file", F.col("child").alias("record"), F.when(F.col("named"), F.col("key")).alias("source_key")
    )


def read_predictions(docs: DataFrame) -> DataFrame:
    """Records of a prediction document: a list, or the first list under a known key."""
    return unwrap_records(docs, V.PREDICTION_KEYS).filter(F.col("source_key").isNull()).select("source_file", "record")


def candidate_rows(docs: DataFrame) -> DataFrame:
    """Objects of a document that may be result rows.

    The root object, the objects in known collections (lists or objects of objects, whose
    key becomes container_key), and the objects of a top-level list.
    Output: source_file, row_id, container_key, row.
    """
    doc, top = F.col("doc"), F.col("_object")
    box = lambda name, v, inside: F.struct(F.lit(name).alias("name"), v.alias("v"), inside.alias("inside"))
    boxes = F.array(
        box("$", doc, ~top), *[box(k, F.when(top, _get(doc, k)), F.lit(True)) for k in V.ROW_COLLECTION_KEYS]
    )
    opened = (
        # Exploded, a document is parsed once: a filter on a plain column would move below and parse it again.
        docs.select("source_file", F.explode(F.array(doc)).alias("doc")).withColumn("_object", is_object(doc))
        .select("source_file", F.inline(boxes).alias("name", "v", "inside")).filter(F.col("v").isNotNull())
    )
    rows = _explode(opened, F.when(F.col("inside"), F.col("v")), ["source_file", "name", "v", "inside"])
    place = F.when(F.col("key").isNull(), F.concat("name", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(
        F.concat("name", F.lit("."), "key")
    )
    return rows.select(
        "source_file", F.when(F.col("inside"), place).otherwise(F.col("name")).alias("row_id"),
        F.col("key").alias("container_key"),
        F.when(F.col("inside"), F.col("child")).otherwise(F.col("v")).alias("row"),
    ).filter(is_object(F.col("row")))


def _opened(leaves: DataFrame, keep: list[str]) -> DataFrame:
    """Objects replaced by their fields, everything else as it is: keep, key (dotted path), v."""
    # The table function also emits pos, key and value, so other columns get other names.
    named = leaves.select(*[F.col(c).alias(f"_k_{c}") for c in keep], F.col("key").alias("_path"), F.col("v").alias("_v"))
    named = named.withColumn("_open", is_object(F.col("_v")))
    out = named.lateralJoin(leaves.sparkSession.tvf.variant_explode_outer(F.when(F.col("_open"), F.col("_v")).outer()))
    path = F.concat_ws(".", F.nullif("_path", F.lit("")), "key")
    return out.select(
        *[F.col(f"_k_{c}").alias(c) for c in keep], F.when(F.col("_open"), path).otherwise(F.col("_path")).alias("key"),
        F.when(F.col("_open"), F.col("value")).otherwise(F.col("_v")).alias("v"),
    ).filter(F.col("v").isNotNull())


LEVELS = 3


def flatten(rows: DataFrame, max_list: int = 10, keep: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """Leaves by dotted path: scalars, and lists of at most max_list scalars as JSON text.

    The first levels are opened one after another in the JVM; what is still an object below
    them, however deep, is walked in Arrow batches.
    Output: the kept columns (source_file, row_id), key, value, type.
    """
    keep = keep or ["source_file", "row_id"]
    v = F.col("v")
    found = rows.select(*keep, F.lit("").alias("key"), F.col("row").alias("v")).filter(v.isNotNull())
    for _ in range(levels):
        found = _opened(found, keep)
    items = F.try_variant_get(v, "$", "array<variant>")
    short = (F.size(items) <= max_list) & ~F.exists(items, lambda x: is_object(x) | is_array(x))
    found = found.withColumn("_kind", F.when(is_object(v), "object").when(is_array(v), "array").otherwise(kind(v)))
    none = (F.col("_kind") == "array") & ~F.coalesce(short, F.lit(True))
    json = F.to_json("v")
    text = F.when(F.col("_kind") == "string", F.try_variant_get(v, "$", "string")).otherwise(F.nullif(json, F.lit("null")))
    whole = (F.col("_kind") == "decimal") & ~F.contains(json, F.lit("."))
    kinds = F.when(whole, "bigint").otherwise(F.col("_kind"))
    leaf = F.struct(F.lit("").alias("key"), text.alias("value"), kinds.alias("type"))
    below = json_walk.leaves_udf(max_list)(F.when(F.col("_kind") == "object", json))
    out = found.select(
        # A filter on the kind would find it out twice.
        *keep, F.col("key").alias("_path"), F.explode(F.when(F.col("_kind") == "object", below).when(~none, F.array(leaf))).alias("leaf")
    )
    path = F.concat_ws(".", F.nullif("_path", F.lit("")), F.nullif("leaf.key", F.lit("")))
    return out.select(*keep, path.alias("key"), "leaf.value", "leaf.type")


def find_records(
    docs: DataFrame, key_aliases: dict[str, list[str]] | None = None, required: list[str] | None = None
) -> DataFrame:
    """Every nested object that has the required fields under one of their aliases.

    Output: source_file, json_path, one text column per alias list (lists as JSON text).
    """
    aliases = key_aliases or V.PROBE_RECORD_KEYS
    required = required or ["entity", "relation", "label", "response"]
    walk = json_walk.records_udf(aliases, required)
    found = docs.filter(F.col("doc").isNotNull()).select("source_file", F.explode(walk(F.to_json("doc"))).alias("found"))
    return found.select("source_file", "found.json_path", *[F.col("found")[n].alias(n) for n in aliases])


def read_entity_values(docs: DataFrame) -> DataFrame:
    """Scalars per entity under `per_entity`, with their key aliases: entity, ve, br, lb."""
    rows = _explode(docs.filter(F.col("doc").isNotNull()), _get("doc", "per_entity"), ["source_file"])

    def num(*keys: str) -> Column:
        v = F.coalesce(*[F.try_variant_get("child", f"$['{k}']", "double") for k in keys])
        return F.when(~F.isnan(v), v)

    return rows.filter(is_object(F.col("child"))).select(
        "source_file", F.col("key").alias("entity"),
        num("ve", "ve_mean").alias("ve"),
        num("bridge", "bridge_mean", "br", "br_mean").alias("br"),
        num("lb", "lb_mean").alias("lb"),
    )
