"""Writers of the workflows' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import sample_id
from .readers import in_file_order
from .shared import stored


#: The folder, below a folder of matrices, of the table that lists their files.
MANIFEST = "_manifest"


def write_clean_matrix(clean: DataFrame, folder: str) -> None:
    """Final markers, one folder per map: a header, then the rows in order, genotypes split by tabs. Maps without markers
    get none.

    Maps differ in their number of samples, so a row is one text line. Tasks write ranges of the order (map, then
    place), so a map that is large has several files, in order of their names; ``read_matrix_manifest`` lists them, and
    one after the other they are the map's matrix.
    """
    line = F.concat_ws("\t", "chromosome", "coordinate", "snp_name", F.array_join(F.split("genotypes", ""), "\t"))
    clean = stored(clean, "clean")  # read for the headers, the bounds of the ranges and the lines
    rows = clean.select("map", line.alias("value"), "chromosome", "coordinate", "snp_name")
    heads = matrix_header(clean).select("map", F.col("header").alias("value"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("chromosome", "coordinate", "snp_name")], F.lit(0).alias("_kind"))
    rows = rows.withColumn("_kind", F.lit(1)).unionByName(heads).orderBy("map", "_kind", F.col("chromosome").asc_nulls_first(), "coordinate", "snp_name")
    rows.select("map", "value").write.mode("overwrite").partitionBy("map").text(folder)
    _files(clean.sparkSession, folder).write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")


def _matrix_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their map as text, whatever its values look like."""
    return spark.read.schema("value string, map string").text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    per = _matrix_lines(spark, folder).groupBy("map", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("map").orderBy("file")) - F.col("lines")
    return per.select("map", "file", before.alias("first_line"), "lines")


def read_matrix_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """map, file, first_line (lines of the map before it), lines: one row a file."""
    return spark.read.parquet(f"{folder}/{MANIFEST}")


def read_clean_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """map, line (0 is the header) and value of the matrices in a folder."""
    rows = in_file_order(_matrix_lines(spark, folder), ["map", "value", F.col("_metadata.file_path").alias("file")])
    at = rows.groupBy("file").agg(F.min("input_ord").alias("_from"))
    files = read_matrix_manifest(spark, folder).select("file", "first_line")
    return rows.join(at.join(files, "file"), "file").select("map", (F.col("input_ord") - F.col("_from") + F.col("first_line")).alias("line"), "value")


def matrix_header(clean: DataFrame) -> DataFrame:
    """map and its header line."""
    rows = clean.groupBy("map").agg(F.max(F.length("genotypes")).alias("n"))
    names = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: sample_id(F.col("map"), i))
    return rows.filter("n > 0").select("map", F.concat_ws("\t", F.lit("chromosome"), F.lit("coordinate"), F.lit("snp_name"), F.array_join(names, "\t")).alias("header"))


def write_events(events: DataFrame, path: str) -> None:
    """Tab-separated with header, in order of map, sample, chromosome and position."""
    order = ["map", F.regexp_extract("sample_id", "_ind([0-9]+)$", 1).cast("int"), "chromosome", "event_bp"]
    events.orderBy(*order).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_qc_summary(rows: DataFrame, path: str) -> None:
    rows.orderBy("map").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_bed(rows: DataFrame, path: str, columns: tuple[str, ...] = ("chrom", "start", "end", "ident")) -> None:
    """Tab-separated without header, by chromosome name and start, ties by the other columns."""
    rows.select(*columns).orderBy("chrom", "start", *[c for c in columns if c not in ("chrom", "start")]).write.mode("overwrite").csv(path, sep="\t", header=False)


def write_plot_data(rows: DataFrame, path: str) -> None:
    """The data of a figure (a profile or a cumulative curve) as CSV."""
    rows.write.mode("overwrite").csv(path, header=True)
