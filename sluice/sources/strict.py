"""Loaders that keep what is wrong beside what is right.

Every record is parsed as a variant and held to the exact keys and JSON types of its kind and to the content rules. What
passes becomes typed rows; what does not becomes a row with its file, its text and the reasons.

An array file is cut without being parsed as a whole: it is read in pieces that end at a closing brace. Whether a piece
begins inside a string follows from the quotes before it, and how deep it is nested from the brackets before it: two
running sums, inside the blocks in which Spark reads a file and over the sizes of a file's blocks. A record ends where
the depth is back at the array's own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import schemas
from sluice.functions.contract import classification_flags, content_flags
from sluice.functions.json_shape import CLASSIFICATION_TYPES, CONTENT_TYPES, OBJECT, STRING, json_type, parse_strict, shape_flags
from sluice.functions.text import flag_list, is_blank
from sluice.sources.workspace import settle

MESSAGE_TYPES: Mapping[str, tuple[str, ...]] = {"id": STRING, "source_area": STRING, "message": STRING}
REFERENCE_TYPES: Mapping[str, tuple[str, ...]] = {"id": STRING, "expected": OBJECT, "justification": STRING}


def line_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record) of files with one record on each line; blank lines are none."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record"))
    return lines.where(~is_blank(F.col("record")))


def _bracket_change(text: Column) -> Column:
    """Opened less closed brackets of a text without strings."""
    opened, closed = (F.length(text) - F.length(F.translate(text, signs, "")) for signs in ("{[", "}]"))
    return opened - closed


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record) of files that hold one top-level array each, pretty-printed or not.

    What stands before, between and behind the objects comes out with the object after it, or as a record of its own at the
    end of a file, unless it is the array's own brackets and commas. So it is turned away later and not lost.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece")
    )
    bare = F.regexp_replace("piece", r"\\.", "")
    strings = r'"[^"]*+"?+'
    pieces = settle(
        pieces.withColumn("_bare", bare)
        .withColumn("_quotes", F.length("_bare") - F.length(F.translate("_bare", '"', "")))
        .withColumn("_outside", _bracket_change(F.regexp_replace("_bare", strings, "")))
        .withColumn("_inside", _bracket_change(F.regexp_replace(F.regexp_replace("_bare", r'^[^"]*+"?+', ""), strings, "")))
        .drop("_bare")
    )
    earlier = W.partitionBy("file", "block").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    blocks_before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)

    def running(rows: DataFrame, value: str, name: str) -> DataFrame:
        """The sum of ``value`` over all pieces of the file before each one; a block's rows are bounded by its size."""
        sums = rows.groupBy("file", "block").agg(F.sum(value).alias("_sum"))
        sums = sums.select("file", "block", F.coalesce(F.sum("_sum").over(blocks_before), F.lit(0)).alias("_base"))
        near = rows.withColumn("_near", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
        return near.join(sums, ["file", "block"]).withColumn(name, F.col("_near") + F.col("_base")).drop("_near", "_base")

    told = running(pieces, "_quotes", "_quotes_before")
    within = F.col("_quotes_before") % 2 == 1
    ends_inside = (F.col("_quotes_before") + F.col("_quotes")) % 2 == 1
    told = told.withColumn("_change", F.when(within, F.col("_inside")).otherwise(F.col("_outside")) - F.when(ends_inside, 0).otherwise(1))
    told = running(told.withColumn("_ends_inside", ends_inside), "_change", "_depth_before")
    ends = ~F.col("_ends_inside") & (F.col("_depth_before") + F.col("_change") == 1)
    told = running(told.withColumn("_ends", ends.cast("long")), "_ends", "_number")
    parts = told.select("file", F.col("_number").alias("number"), "block", "place", "piece", "_ends")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "piece"))), lambda p: p["piece"])
    records = parts.groupBy("file", "number").agg(F.array_join(joined, "}").alias("text"), F.max("_ends").alias("_whole"))
    # The reader drops the brace that ends a piece; a file's last piece has none.
    first = F.when(F.col("number") == 0, F.regexp_replace("text", r"^(?:﻿)?\s*\[", "")).otherwise(F.regexp_replace("text", r"^\s*,", ""))
    text = F.when(F.col("_whole") == 1, F.concat(F.trim(first, F.lit(" \t\r\n")), F.lit("}"))).otherwise(F.trim(F.regexp_replace("text", r"\s*$", ""), F.lit(" \t\r\n")))
    records = records.select("file", text.alias("record"), (F.col("_whole") == 1).alias("_whole"), "number")
    rest = F.when(F.col("number") == 0, ~F.col("record").rlike(r"^(?:﻿)?\[\s*\]\}?$")).otherwise(F.col("record") != "]")
    return records.where(F.col("_whole") | rest).select("file", F.when(F.col("_whole"), F.col("record")).otherwise(F.regexp_replace("record", r"\}$", "")).alias("record"))


def _blank_flags(names: tuple[str, ...]) -> list[tuple[str, Column]]:
    return [(f"blank:{name}", F.coalesce(is_blank(F.col(f"_r.{name}")), F.lit(True))) for name in names]


def quarantine(records: DataFrame, types: Mapping[str, tuple[str, ...]], schema: T.StructType, rules: Column, nested: tuple[str, Mapping] | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed rows with their ``file``, rejected ``file, record, reasons``) of ``file, record`` rows.

    ``rules`` are the flags of a record ``_r`` of the right shape; ``nested`` names a field that holds a closed object.
    """
    read = records.withColumn("_value", parse_strict(F.col("record")))
    shape = shape_flags(F.col("record"), F.col("_value"), types)
    if nested:
        name, inner = nested
        part = F.try_variant_get("_value", f"$.{name}", "variant")
        text = F.get_json_object("record", f"$.{name}")
        below = F.transform(shape_flags(text, part, inner), lambda flag: F.concat(F.lit(f"{name}."), flag))
        shape = F.concat(shape, F.when(F.coalesce(json_type(part).isin(*OBJECT), F.lit(False)), below).otherwise(F.array().cast("array<string>")))
    read = read.withColumn("_shape", F.when(F.col("_value").isNull(), F.array(F.lit("not_json"))).otherwise(shape))
    read = read.withColumn("_r", F.when(F.size("_shape") == 0, F.from_json("record", schema)))
    read = read.withColumn("reasons", F.when(F.size("_shape") > 0, F.col("_shape")).otherwise(rules))
    judged = settle(read.select("file", "record", "_r", "reasons"))
    fine = F.size("reasons") == 0
    return judged.where(fine).select("file", "_r.*"), judged.where(~fine).select("file", "record", "reasons")


def _records(spark: SparkSession, path: str, array: bool) -> DataFrame:
    return array_records(spark, path) if array else line_records(spark, path)


def messages(spark: SparkSession, path: str, array: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages, rejected): three text fields and no others, none of them blank."""
    return quarantine(_records(spark, path, array), MESSAGE_TYPES, schemas.MESSAGE, flag_list(*_blank_flags(tuple(MESSAGE_TYPES))))


def references(spark: SparkSession, path: str, array: bool = False) -> tuple[DataFrame, DataFrame]:
    """(references, rejected): an expected content that keeps the contract, and a justification."""
    content = content_flags(lambda name: F.col(f"_r.expected.{name}"))
    rules = flag_list(*content, *_blank_flags(("justification",)))
    return quarantine(_records(spark, path, array), REFERENCE_TYPES, schemas.REFERENCE, rules, ("expected", CONTENT_TYPES))


def results(spark: SparkSession, path: str, array: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, rejected): classifications of one prompt version a file; a file of several is rejected whole."""
    rules = flag_list(*classification_flags(lambda name: F.col(f"_r.{name}")))
    good, bad = quarantine(_records(spark, path, array), CLASSIFICATION_TYPES, schemas.CLASSIFICATION, rules)
    mixed = good.groupBy("file").agg((F.min("version_prompt") != F.max("version_prompt")).alias("_mixed")).where("_mixed")
    told = good.join(mixed, "file", "left_semi")
    names = [F.col(name) for name in schemas.CLASSIFICATION.fieldNames()]
    whole = told.select("file", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("record"), F.array(F.lit("mixed_versions")).alias("reasons"))
    return good.join(mixed, "file", "left_anti"), bad.unionByName(whole)
