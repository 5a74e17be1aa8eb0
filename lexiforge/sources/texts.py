"""Text sources: dictionaries, table texts, metas, segmentations, CoNLL files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import drop_signs, strip_space


def dictionary(lines: DataFrame, drop_soft_signs: bool = False) -> DataFrame:
    """Distinct words of lines (value): stripped, without blank lines and # comments; optionally without soft and hard signs."""
    word = lines.select(strip_space(F.col("value")).alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return word.select((drop_signs(F.col("value")) if drop_soft_signs else F.col("value")).alias("value")).distinct()


def dictionaries(spark: SparkSession, inflexions: str | None = None, suffixes: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Both dictionaries as tables (value): inflexions as written, suffixes without soft and hard signs; None where no file is given."""
    read = lambda path, bare: dictionary(spark.read.text(path), bare) if path else None
    return read(inflexions, False), read(suffixes, True)


def decoded(path):
    """A path as it is; Spark gives it percent-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def tables(spark: SparkSession, folder: str) -> DataFrame:
    """template_name, value of a folder's .table files; % in a file's name stands for /."""
    rows = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.table").load(folder)
    name = decoded(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.table$", ""))
    return rows.select(F.translate(name, "%", "/").alias("template_name"), "value")


def metas(spark: SparkSession, path: str) -> DataFrame:
    """morfo, template_name, stems from lines morfo;template;stem;...; blank lines are left out."""
    lines = spark.read.text(path).select(F.split(strip_space(F.col("value")), ";").alias("f")).where(F.size("f") >= 2)
    return lines.select(F.col("f")[0].alias("morfo"), F.col("f")[1].alias("template_name"), F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))).alias("stems"))


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """doc (the file's whole path), value."""
    return spark.read.format("text").option("wholetext", True).load(path).select(decoded(F.col("_metadata.file_path")).alias("doc"), "value")


def segmentations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """doc (the file's whole path), word_id, value of segmentation files, one word a line. Ids tell words apart and grow along a file."""
    return spark.read.text(path).select(decoded(F.col("_metadata.file_path")).alias("doc"), F.monotonically_increasing_id().alias("word_id"), "value")
