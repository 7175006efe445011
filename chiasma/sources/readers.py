"""Readers of the workflows' files. Text is read as text and cast with ``try_cast``, so bad fields are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import chrom_name, chrom_name_strict
from ..operators.ordered import stretched, within
from .shared import stored

#: Rows to a stretch of running numbers.
NUMBERED = 1 << 20

# What counts as missing in tables read with a permissive text reader.
MISSING = ["", "NA", "N/A", "NULL", "null", "NaN", "nan", "n/a", "None", "#N/A", "<NA>"]


def in_file_order(rows: DataFrame, columns: list[str | Column]) -> DataFrame:
    """``columns`` of a file scan and ``input_ord``, numbers that ascend by file name and place in the file.

    Spark deals pieces of files to tasks in an order of its own, so a row's running id is taken from where its piece
    begins; a table of one row a piece has how many rows are before it.
    """
    own = rows.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")).withColumn("_id", F.monotonically_increasing_id())
    per = own.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), (F.max("_id") - F.min("_id") + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_at")) - F.col("_n") - F.col("_first")
    return own.join(per.select("_file", "_at", before.alias("_before")), ["_file", "_at"]).select(*own.columns[:-3], (F.col("_id") + F.col("_before")).alias("input_ord"))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line and input_ord, ascending by file name and place in the file."""
    rows = in_file_order(spark.read.text(path), ["value"])
    return rows.select(F.regexp_replace("value", "\r$", "").alias("line"), "input_ord")


def _field(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def _present(x: Column) -> Column:
    return F.when(~F.trim(x).isin(MISSING), x)


def _long(x: Column) -> Column:
    return x.try_cast("double").try_cast("bigint")


def read_markers(spark: SparkSession, path: str, fmt: str = "csv", **options: str) -> DataFrame:
    """map, input_ord, chromosome, coordinate, snp_name, genotypes; columns found by name, in any order.

    ``fmt``: csv (header; tab by default), parquet, or xlsx (see ``xlsx.read_sheet``).
    """
    if fmt == "parquet":
        rows = spark.read.parquet(path)
    elif fmt == "xlsx":
        from .xlsx import read_sheet

        rows = read_sheet(spark, path, **options)
    else:
        rows = spark.read.options(header=True, sep="\t", **options).csv(path)
    if "input_ord" not in rows.columns:
        rows = in_file_order(rows, ["map", "SNP_name", "chr_phy", "coordinate", "raw_data"])
    return rows.select("map", "input_ord", F.col("chr_phy").cast("string").alias("chromosome"), F.col("coordinate").cast("string").alias("coordinate"), F.col("SNP_name").cast("string").alias("snp_name"), F.col("raw_data").cast("string").alias("genotypes"))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length of chr1 to chr10 from a sequence index."""
    rows = spark.read.csv(path, sep="\t", schema="name string, length string, offset string, linebases string, linewidth string")
    rows = rows.select(F.col("name").alias("chrom"), _long(F.col("length")).alias("length"))
    return rows.filter(F.col("chrom").rlike("^chr[0-9]+$") & F.substring("chrom", 4, 9).try_cast("int").between(1, 10))


def _gff(spark: SparkSession, path: str, comment_anywhere: bool) -> DataFrame:
    rows = _lines(spark, path)
    text = F.regexp_replace("line", "#.*$", "") if comment_anywhere else F.when(~F.col("line").startswith("#"), F.col("line"))
    rows = rows.withColumn("_p", F.split(text, "\t")).filter(F.length(F.coalesce(text, F.lit(""))) > 0)
    names = ["chr", "source", "feature", "start", "end", "score", "strand", "phase", "attributes"]
    return rows.select("input_ord", F.size("_p").alias("fields"), *[_field(F.col("_p"), i).alias(n) for i, n in enumerate(names)])


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Genes for profiles: input_ord, chr, start (0-based), end, strand + or -. ``#`` cuts a line anywhere."""
    rows = _gff(spark, path, True).filter(F.col("feature") == "gene")
    rows = rows.select("input_ord", chrom_name(_present(F.col("chr"))).alias("chr"), (_long(_present(F.col("start"))) - 1).alias("start"), _long(_present(F.col("end"))).alias("end"), "strand")
    return rows.dropna(subset=["chr", "start", "end"]).filter(F.col("strand").isin("+", "-"))


def renamed_chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (name, chrom) that normalising changes beyond trimming: what a reader should be warned of."""
    rows = _gff(spark, path, True).select(F.trim("chr").alias("name")).distinct()
    return rows.withColumn("chrom", chrom_name(F.col("name"))).filter("name <> chrom")


def read_gene_spans(spark: SparkSession, path: str, lengths: DataFrame) -> DataFrame:
    """Genes for region classes: chrom (known ones), start (0-based), end, strand as it is. Whole-line comments only."""
    rows = _gff(spark, path, False).filter((F.col("feature") == "gene") & (F.col("fields") >= 9))
    rows = rows.select(chrom_name_strict(F.col("chr")).alias("chrom"), (_long(F.col("start")) - 1).alias("start"), _long(F.col("end")).alias("end"), "strand")
    return rows.join(lengths.select("chrom"), "chrom", "left_semi")


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """chr, start, end, value; a fourth column that is no number counts as 1. Fewer than three columns are an error."""
    head = spark.read.text(path).filter("value <> '' and not startswith(value, '#')").select(F.size(F.split("value", "\t")).alias("n")).head()
    if head is not None and head["n"] < 3:
        raise ValueError("signal needs at least chrom, start and end")
    rows = spark.read.csv(path, sep="\t", schema="chr string, start string, end string, value string", comment="#")
    value = F.coalesce(F.nanvl(F.col("value").try_cast("double"), F.lit(None).cast("double")), F.lit(1.0))
    rows = rows.select(chrom_name(_present(F.col("chr"))).alias("chr"), _long(_present(F.col("start"))).alias("start"), _long(_present(F.col("end"))).alias("end"), value.alias("value"))
    return rows.dropna(subset=["chr", "start", "end"])


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, sample, id of a BED with up to five columns; comments and blank lines are skipped."""
    rows = spark.read.csv(path, sep="\t", schema="chrom string, start string, end string, sample string, id string", comment="#")
    return rows.withColumns({"start": _long(F.col("start")), "end": _long(F.col("end"))}).dropna(subset=["chrom", "start", "end"])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event table with header; carriage returns go."""
    rows = spark.read.csv(path, sep="\t", header=True)
    rows = rows.select(*[F.regexp_replace(F.col(f"`{c}`"), "\r", "").alias(c.strip("\r")) for c in rows.columns])
    kinds = {"chromosome": "int", "event_index": "int", "event_bp": "bigint", "left_coordinate": "bigint", "right_coordinate": "bigint"}
    return rows.withColumns({c: F.col(c).try_cast(t) for c, t in kinds.items() if c in rows.columns})


def read_centromeres(spark: SparkSession, path: str) -> DataFrame:
    """line, chrom, start, end (half-open; the file's ends are closed), assembled."""
    rows = spark.read.csv(path, header=True)
    a, b, c, d, _, f = rows.columns[:6]
    return rows.select(F.col(f"`{a}`").alias("line"), F.col(f"`{b}`").alias("chrom"), _long(F.col(f"`{c}`")).alias("start"), (_long(F.col(f"`{d}`")) + 1).alias("end"), (F.col(f"`{f}`") == "Y").alias("assembled"))


def read_chain(spark: SparkSession, path: str | list[str], width: int = NUMBERED) -> DataFrame:
    """Aligned blocks of chain files, as ``lift_points`` takes them.

    A chain is a header and lines of (size, gap on the source, gap on the target). A line belongs to the last header
    before it, and its block begins where the sums of the lines since that header end. Headers and sums are carried
    over stretches of ``width`` lines, so a chain of any length is read by many tasks. Lines that begin with no digit,
    and lines before a header, do not count; a block and what follows it in its chain are left out where a field is no
    whole number. All sizes and gaps of the files together have to stay below 2^63.
    """
    part = F.split(F.trim("line"), r"\s+")
    number = lambda i: F.get(part, F.lit(i)).try_cast("bigint")
    gap = lambda i: F.when(F.size(part) > i, number(i)).otherwise(F.lit(0).cast("bigint"))
    is_head = F.col("line").startswith("chain")
    text = {n: F.get(part, F.lit(i)) for i, n in ((2, "chrom"), (7, "t_chrom"), (9, "t_strand"))}
    whole = {n: number(i) for i, n in ((5, "s"), (8, "t_size"), (10, "t"))}
    lines = _lines(spark, path).filter(is_head | F.col("line").rlike("^[0-9]"))
    lines = lines.select("input_ord", F.when(is_head, F.struct(*[c.alias(n) for n, c in (text | whole).items()])).alias("head"), *[F.when(~is_head, c).alias(n) for n, c in (("n", number(0)), ("ds", gap(1)), ("dt", gap(2)))])
    lines = stored(lines, "chain-lines")
    wrong = (F.col("head").isNull() & (F.col("n").isNull() | F.col("ds").isNull() | F.col("dt").isNull())).cast("int")
    zero = F.lit(0).cast("bigint")
    sums = {"s_sum": F.coalesce(F.col("n") + F.col("ds"), zero), "t_sum": F.coalesce(F.col("n") + F.col("dt"), zero), "wrong": wrong}
    rows = stretched(lines, [], F.col("input_ord"), {f"_{c}": ("sum", v) for c, v in sums.items()}, width)
    upto = within([], "input_ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.col(f"_{c}") + F.sum(v).over(upto) for c, v in sums.items()}).drop("_stretch", *[f"_{c}" for c in sums])
    # the last header, with the sums up to it
    head = F.when(F.col("head").isNotNull(), F.struct("input_ord", "head", *sums))
    rows = stretched(rows, [], F.col("input_ord"), {"_last": ("max", head)}, width)
    rows = rows.withColumn("h", F.coalesce(F.last(head, ignorenulls=True).over(upto), F.col("_last")))
    rows = rows.filter("head is null and h is not null and wrong = h.wrong")
    at_s = F.col("h.head.s") + F.col("s_sum") - F.col("h.s_sum") - F.col("n") - F.col("ds")
    at_t = F.col("h.head.t") + F.col("t_sum") - F.col("h.t_sum") - F.col("n") - F.col("dt")
    rows = rows.select("h.head.*", "n", at_s.alias("at_s"), at_t.alias("at_t"))
    # coordinates of a - target run on its reverse strand
    start = F.when(F.col("t_strand") == "-", F.col("t_size") - F.col("at_t") - F.col("n")).otherwise(F.col("at_t"))
    rows = rows.select("chrom", F.col("at_s").alias("w_start"), (F.col("at_s") + F.col("n")).alias("w_end"), "t_chrom", start.alias("t_start"), "t_strand")
    return rows.dropna(subset=["w_start", "t_start"])


def read_map_markers(spark: SparkSession, path: str, columns: tuple[str, str, str, str] = ("chr", "pos", "cM", "marker")) -> DataFrame:
    """A genetic map as single bases: chrom, start, end, cm, marker."""
    c, p, m, n = (F.col(f"`{x}`") for x in columns)
    rows = spark.read.csv(path, header=True)
    return rows.select(chrom_name_strict(c).alias("chrom"), _long(p).alias("start"), (_long(p) + 1).alias("end"), m.try_cast("double").alias("cm"), n.alias("marker")).dropna(subset=["chrom", "start"])


def _numbered(rows: DataFrame, prefix: str) -> DataFrame:
    """``id``: prefix and the running number in input order; totals are carried over stretches of it, so no single task
    sorts all."""
    rows = stretched(rows, [], F.col("input_ord"), {"_before": ("sum", F.lit(1))}, NUMBERED)
    number = F.col("_before") + F.row_number().over(within([], "input_ord"))
    return rows.withColumn("id", F.format_string(prefix + "_%06d", number)).drop("_before", "_stretch", "input_ord")


def read_segment_tables(spark: SparkSession, paths: list[str], prefix: str = "RMv2") -> DataFrame:
    """Segment tables with chromosome, sample and ends in columns 1, 3, 5, 6; heterozygous and family lines go."""
    rows = _lines(spark, paths).filter(~F.col("line").contains("het") & ~F.col("line").contains("Family") & (F.col("line") != ""))
    p = F.split(F.regexp_replace("line", "\r", ""), "\t")
    rows = rows.select(_field(p, 0).alias("chrom"), _long(_field(p, 4)).alias("start"), _long(_field(p, 5)).alias("end"), _field(p, 2).alias("sample"), "input_ord")
    return _numbered(rows, prefix)


def read_crossover_tables(spark: SparkSession, paths: list[str], prefix: str = "Pennyv2") -> DataFrame:
    """Crossover tables with chromosome, ends and sample in columns 1, 2, 3, 7; header lines go."""
    rows = _lines(spark, paths).filter(~F.col("line").rlike(r"^chr\s") & (F.col("line") != ""))
    p = F.split(F.regexp_replace("line", "\r", ""), "\t")
    rows = rows.select(_field(p, 0).alias("chrom"), _long(_field(p, 1)).alias("start"), _long(_field(p, 2)).alias("end"), _field(p, 6).alias("sample"), "input_ord")
    return _numbered(rows, prefix)


def event_intervals(events: DataFrame, prefix: str = "EUROv2") -> DataFrame:
    """The event table as intervals: chromosome, left and right coordinate, sample, running id in table order."""
    keys = ["map", "sample_id"]
    events = stored(events.select(*keys, "chromosome", "event_bp", "left_coordinate", "right_coordinate"), "event-intervals")
    # events of a sample in one window, and a table of one row a sample with how many are before it
    per = events.groupBy(*keys).agg(F.count("*").alias("_n"))
    along = Window.partitionBy("map").orderBy("sample_id")
    maps = events.groupBy("map").agg(F.count("*").alias("_m")).select("map", (F.sum("_m").over(Window.orderBy("map")) - F.col("_m")).alias("_maps"))
    per = per.join(maps, "map").select(*keys, (F.col("_maps") + F.sum("_n").over(along) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy("chromosome", "event_bp"))
    rows = events.join(per, keys).withColumn("id", F.format_string(prefix + "_%06d", number))
    return rows.select(F.col("chromosome").cast("string").alias("chrom"), F.col("left_coordinate").alias("start"), F.col("right_coordinate").alias("end"), F.col("sample_id").alias("sample"), "id")
