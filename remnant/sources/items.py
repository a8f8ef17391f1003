"""Evaluation items from annotation files or one folder per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remnant.functions import text as T
from remnant.sources.files import list_files

_RAW = """image string, question string, answer string, gt string, entity string, name string,
aliases array<string>, keywords array<string>, rephrase_questions array<string>, rephrases array<string>"""
IMAGES = "*.{jpg,jpeg,png}"


def _raw(spark: SparkSession, path, multi_line: bool, glob: str) -> DataFrame:
    return (
        spark.read.schema(_RAW).option("multiLine", str(multi_line).lower())
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )


def _items(raw: DataFrame, dataset: str, split: str, entity, image) -> DataFrame:
    empty = F.array().cast("array<string>")
    name = F.coalesce(F.col("entity"), F.col("name"), entity)
    return raw.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), name.alias("entity"),
        image.alias("image"), "question", F.coalesce("answer", "gt", F.lit("")).alias("answer"),
        F.coalesce("aliases", T.build_aliases(name)).alias("aliases"),
        F.coalesce("keywords", empty).alias("keywords"),
        F.coalesce("rephrase_questions", "rephrases", empty).alias("rephrases"),
    )


def read_items(
    spark: SparkSession, path: str, dataset: str = "", split: str = "", layout: str = "flat",
    multi_line: bool = True, file_glob: str = "*.json", image_glob: str = IMAGES,
    folder_regex: str = r"/([^/]+)/[^/]+$",
) -> DataFrame:
    """Items in one schema.

    flat: JSON arrays of items; image paths are relative to the folder of their file.
    folders: one folder per entity with an image and a JSON list or object; the first image
    and `qa.json` (else the first JSON file) of a folder are used, folders lacking either
    are skipped.
    """
    raw = _raw(spark, path, multi_line, file_glob)
    if layout == "flat":
        folder = F.regexp_replace("file", "[^/]*$", "")
        absolute = F.startswith(F.col("image"), F.lit("/")) | F.contains(F.col("image"), F.lit("://"))
        image = F.when(absolute, F.col("image")).otherwise(F.concat(folder, "image"))
        return _items(raw.filter(F.col("image").isNotNull()), dataset, split, F.lit("unknown"), image)
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    first_image = list_files(spark, [path], image_glob).groupBy(folder.alias("folder")).agg(
        F.min_by("path", F.struct((~F.endswith(F.lower("path"), F.lit(".jpg"))).alias("o"), "path")).alias("first_image")
    )
    is_qa = F.endswith(F.col("path"), F.lit("/qa.json"))
    chosen = list_files(spark, [path], file_glob).groupBy(folder.alias("folder")).agg(
        F.min_by("path", F.struct((~is_qa).alias("o"), "path")).alias("path")
    ).join(first_image, "folder")
    # Listings and reads spell local paths differently (file:/ and file:///).
    slashes = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    rows = raw.withColumn("_p", slashes("file")).join(
        chosen.select(slashes("path").alias("_p"), "first_image"), "_p"
    )
    return _items(rows, dataset, split, F.regexp_extract("file", folder_regex, 1), F.col("first_image"))
