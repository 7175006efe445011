"""Queries that go through the readers and writers: files made of the driver's tables below the shared folder, read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import genotypes, hmm
from ..sources import readers, sinks
from ..sources.shared import fresh_folder
from ..sources.xlsx import sheet_of
from . import adapters as A
from . import workflows
from .queries import query


def _tabs(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]).alias("value")


def _file(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = f"{fresh_folder(spark, name)}/table"
    lines.write.text(path)
    return path


def _gff(spark: SparkSession, d: str, chrom: Column) -> str:
    """Genes, other features, comments, and names in several spellings."""
    g = A.genes(spark, d)
    one = lambda feature: g.select(_tabs(chrom, F.lit("src"), F.lit(feature), F.col("start") + 1, "end", F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID=g"), F.col("input_ord").cast("string"))))
    notes = g.select(F.concat(F.lit("#gene\t"), F.col("chr")).alias("value"))
    return _file(spark, one("gene").union(one("mRNA")).union(notes), "gff")


def _number() -> Column:
    return F.substring("chr", 4, 9)


@query
def read_gff_genes(spark, d):
    spelled = F.when(F.col("input_ord") % 3 == 0, F.concat(F.lit("CHR"), _number())).when(F.col("input_ord") % 3 == 1, F.concat(F.lit("Chr"), _number())).otherwise(F.col("chr"))
    return readers.read_genes(spark, _gff(spark, d, spelled)).select("chr", "start", "end", "strand")


@query
def read_gff_spans(spark, d):
    spelled = F.when(F.col("input_ord") % 3 == 0, _number()).when(F.col("input_ord") % 3 == 1, F.concat(F.lit("Chr"), _number())).otherwise(F.col("chr"))
    known = A.lengths(spark, d).filter("chrom <> 'chr3'")
    return readers.read_gene_spans(spark, _gff(spark, d, spelled), known).select("chrom", "start", "end", "strand")


@query
def read_bed_signal(spark, d):
    s = A.signal(spark, d)
    value = F.when(F.col("id") % 5 == 0, "NA").when(F.col("id") % 5 == 1, "nan").otherwise(F.col("value").cast("string"))
    start = F.when(F.col("id") % 11 == 0, F.lit("x")).otherwise(F.col("start").cast("string"))
    return readers.read_signal(spark, _file(spark, s.select(_tabs("chr", start, "end", value, F.lit("more"))), "bed"))


@query
def read_bed_lengths(spark, d):
    """The length distribution of a BED file."""
    from ..operators import sampling

    rows = A.signal(spark, d).select(_tabs("chr", "start", "end"))
    return sampling.length_distribution(readers.read_intervals(spark, _file(spark, rows, "bed")))


@query
def read_sequence_index(spark, d):
    rows = A.lengths(spark, d).select("chrom", "length")
    more = rows.select(F.concat(F.lit("scaf_"), F.substring("chrom", 4, 9)).alias("chrom"), "length").union(rows.select(F.concat("chrom", F.lit("7")).alias("chrom"), "length"))
    return readers.read_lengths(spark, _file(spark, rows.union(more).select(_tabs("chrom", "length", F.lit(6), F.lit(80), F.lit(81))), "fai"))


@query
def read_event_table(spark, d):
    path = f"{fresh_folder(spark, 'events')}/table"
    sinks.write_events(hmm.call_events(genotypes.clean(A.markers(spark, d))), path)
    return readers.read_events(spark, path)


@query
def read_marker_table(spark, d):
    """Markers from a file with columns in another order, deduplicated."""
    path = f"{fresh_folder(spark, 'markers')}/table"
    A.markers(spark, d).selectExpr("genotypes raw_data", "coordinate", "map", "chromosome chr_phy", "snp_name SNP_name").write.csv(path, sep="\t", header=True)
    rows = genotypes.deduplicate(genotypes.required(readers.read_markers(spark, path)))
    return rows.select("map", "chromosome", "coordinate", "snp_name", "genotypes")


#: Rows of a workbook that ``read_workbook`` makes at most; a sheet has to stay below 2^20.
BOOK_ROWS = 20_000


def _workbook(rows: pd.DataFrame) -> bytes:
    """A workbook with names and maps as shared strings, genotypes within the cells, and numbers."""
    names = ["map", "SNP_name", "chr_phy", "coordinate", "raw_data"]
    texts = sorted({*names, *rows["map"], *rows["snp_name"]})
    at = {t: i for i, t in enumerate(texts)}
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared = lambda t: f'<c t="s"><v>{at[t]}</v></c>'
    lines = ['<row r="1"/>', '<row r="3">' + "".join(map(shared, names)) + "</row>"]
    for m, n, c, p, g in rows[["map", "snp_name", "chromosome", "coordinate", "genotypes"]].itertuples(index=False):
        lines.append(f'<row>{shared(m)}{shared(n)}<c><v>{c}</v></c><c><v>{p}</v></c><c t="inlineStr"><is><t>{g}</t></is></c></row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="Markers" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>" + "".join(lines) + "</sheetData></worksheet>")
    return out.getvalue()


@query
def read_workbook(spark, d):
    """Markers from workbooks of ``BOOK_ROWS`` rows at most, read in pieces by many tasks."""
    rows = A.markers(spark, d).withColumn("book", F.concat_ws("/", "map", F.expr(f"string(input_ord div {BOOK_ROWS})")))
    books = rows.groupBy("book").applyInPandas(lambda g: pd.DataFrame({"path": [g["book"].iloc[0]], "content": [_workbook(g)]}), "path string, content binary")
    names = ("map", "SNP_name", "chr_phy", "coordinate", "raw_data")
    found = sheet_of(books, "Markers", 3, names, 1 << 16)
    return found.selectExpr("map", "chr_phy chromosome", "coordinate", "SNP_name snp_name", "raw_data genotypes")


@query
def read_genetic_map(spark, d):
    path = f"{fresh_folder(spark, 'map')}/table"
    A.map_markers(spark, d).selectExpr("marker", "cm cM", "regexp_replace(chrom, 'Brand#', 'Chr') chr", "bp pos").write.csv(path, header=True)
    return readers.read_map_markers(spark, path)


def _in_order(rows: DataFrame, lines: Column, order: list[str]) -> DataFrame:
    return rows.orderBy(*order).select(lines)


@query
def read_segment_tables(spark, d):
    """Running ids follow the lines of the files, which hold lines that do not count."""
    s = A.signal(spark, d)
    kind = F.when(F.col("id") % 7 == 0, "het").otherwise("hom")
    lines = _tabs(F.regexp_replace("chr", "chr", ""), kind, F.concat(F.lit("s"), (F.col("id") % 50).cast("string")), F.lit("q"), "start", F.concat(F.col("end").cast("string"), F.lit("\r")))
    return readers.read_segment_tables(spark, [_file(spark, _in_order(s, lines, ["id", "chr", "start", "end"]), "segments")])


@query
def read_crossover_tables(spark, d):
    s = A.signal(spark, d)
    lines = F.when(F.col("id") % 9 == 0, F.lit("chr\tstart\tend")).otherwise(_tabs("chr", "start", "end", F.lit("a"), F.lit("b"), F.lit("c"), F.concat(F.lit("p"), (F.col("id") % 40).cast("string")))).alias("value")
    return readers.read_crossover_tables(spark, [_file(spark, _in_order(s, lines, ["id", "chr", "start", "end"]), "crossovers")])


@query
def read_chain_blocks(spark, d):
    """A chain of two blocks with a gap for each order; every other one on the reverse strand."""
    o = A.genes(spark, d)
    strand = F.when(F.col("input_ord") % 2 == 0, "+").otherwise("-")
    head = F.concat_ws(" ", F.lit("chain 1"), "chr", F.lit("900000000 +"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("t"), F.lit("800000000"), strand, F.col("start").cast("string"), F.col("end").cast("string"), F.col("input_ord").cast("string"))
    text = F.concat(head, F.lit("\n100\t7\t11\n150\n")).alias("value")
    return readers.read_chain(spark, _file(spark, o.select(text), "chain"))


@query
def read_centromere_table(spark, d):
    path = f"{fresh_folder(spark, 'centromeres')}/table"
    rows = A.lengths(spark, d).selectExpr("'L' line", "chrom Chr", "length div 3 Start", "length div 3 + 999 End", "1000 Size", "if(length % 2 = 0, 'Y', 'N') `Whole (Y/N)`")
    rows.write.csv(path, header=True)
    return readers.read_centromeres(spark, path)


@query
def written_matrices(spark, d):
    """The lines of each map's matrix file, numbered."""
    path = f"{fresh_folder(spark, 'matrices')}/table"
    sinks.write_clean_matrix(genotypes.clean(A.markers(spark, d)), path)
    return sinks.read_clean_matrix(spark, path)


@query
def lifted_intervals(spark, d):
    """Intervals of one table, moved by their ends and rebuilt."""
    rows = A.signal(spark, d).filter("end > start").selectExpr("chr chrom", "start", "end", "string(id) sample", "id")
    return workflows.lifted_intervals(rows, A.chain_blocks(spark))


@query
def united_intervals(spark, d):
    """Intervals of segment tables, crossover tables and called events as one table."""
    tables = [read_segment_tables(spark, d), read_crossover_tables(spark, d), readers.event_intervals(hmm.call_events(genotypes.clean(A.markers(spark, d))))]
    return workflows.united(tables)


@query
def written_bed(spark, d):
    """The lines of a BED file in their order, numbered."""
    path = f"{fresh_folder(spark, 'bed')}/table"
    sinks.write_bed(A.signal(spark, d).selectExpr("chr chrom", "start", "end", "string(id) ident"), path)
    rows = readers.in_file_order(spark.read.text(path), ["value"])
    return rows.select("value", F.col("input_ord").alias("line"))


@query
def written_qc(spark, d):
    """The quality table, written and read back."""
    from .queries import qc_summary

    path = f"{fresh_folder(spark, 'qc')}/table"
    rows = qc_summary(spark, d)
    sinks.write_qc_summary(rows, path)
    return spark.read.schema(rows.schema).csv(path, sep="\t", header=True)
