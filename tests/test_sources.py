"""Readers and writers on small files."""

import random
import zipfile
from urllib.parse import urlparse

from chiasma.operators import hmm  # noqa: F401
from chiasma.sources import readers, sinks, xlsx


def put(path, text):
    path.write_text(text)
    return str(path)


def test_lengths_and_centromeres(spark, tmp_path):
    p = put(tmp_path / "x.fai", "chr1\t100\t6\t80\t81\nchr10\t90\t6\t80\t81\nchr11\t9\t6\t80\t81\nscaf_1\t5\t6\t80\t81\n")
    assert {(r["chrom"], r["length"]) for r in readers.read_lengths(spark, p).collect()} == {("chr1", 100), ("chr10", 90)}
    c = put(tmp_path / "c.csv", "line,Chr,Start,End,Size,Whole (Y/N)\nB,chr1,10,19,10,N\n")
    r = readers.read_centromeres(spark, c).first()
    assert (r["start"], r["end"], r["assembled"]) == (10, 20, False)


def test_genes(spark, tmp_path):
    text = "##gff\nChr1\ts\tgene\t11\t20\t.\t+\t.\tID=1#x\nCHR2\ts\tgene\t5\t9\t.\t.\t.\tID=2\nchr1\ts\tmRNA\t1\t2\t.\t+\t.\tID=3\n3\ts\tgene\tx\t9\t.\t-\t.\tID=4\n#chr1\ts\tgene\t1\t2\t.\t+\t.\tID\nNA\ts\tgene\t1\t2\t.\t+\t.\tID\n"
    p = put(tmp_path / "g.gff", text)
    assert [(r["chr"], r["start"], r["end"], r["strand"]) for r in readers.read_genes(spark, p).collect()] == [("chr1", 10, 20, "+")]
    assert {(r["name"], r["chrom"]) for r in readers.renamed_chromosomes(spark, p).collect()} == {("Chr1", "chr1"), ("CHR2", "chr2")}
    lengths = spark.createDataFrame([("chr1", 100)], "chrom string, length long")
    assert [(r["chrom"], r["start"]) for r in readers.read_gene_spans(spark, p, lengths).collect()] == [("chr1", 10)]


def test_signal(spark, tmp_path):
    p = put(tmp_path / "s.bed", "chr1\t0\t5\t2.5\textra\nchr1\t5\t9\tname\nchr1\t5\t9\nchr1\tNA\t9\t1\nchr1\t5\t5\tnan\n")
    got = sorted((r["start"], r["end"], r["value"]) for r in readers.read_signal(spark, p).collect())
    assert got == [(0, 5, 2.5), (5, 5, 1.0), (5, 9, 1.0), (5, 9, 1.0)]
    bad = put(tmp_path / "bad.bed", "chr1\t5\n")
    try:
        readers.read_signal(spark, bad)
        raise AssertionError("no error")
    except ValueError:
        pass


def test_interval_tables(spark, tmp_path):
    seg = put(tmp_path / "r.txt", "chr\tx\tFamily\ta\tb\tc\r\n1\tx\ts1\tq\t10\t20\r\n1\thet\ts1\tq\t10\t20\r\n2\tx\ts2\tq\t5\t9\r\n")
    got = [(r["chrom"], r["start"], r["end"], r["sample"], r["id"]) for r in readers.read_segment_tables(spark, [seg]).orderBy("id").collect()]
    assert got == [("1", 10, 20, "s1", "RMv2_000001"), ("2", 5, 9, "s2", "RMv2_000002")]
    pen = put(tmp_path / "p.txt", "chr\tstart\tend\n1\t3\t4\ta\tb\tc\tsam\n")
    r = readers.read_crossover_tables(spark, [pen]).first()
    assert (r["chrom"], r["sample"], r["id"]) == ("1", "sam", "Pennyv2_000001")


def test_ids_follow_files_and_lines(spark, tmp_path):
    """Spark packs the largest pieces first; the ids follow the names of the files all the same."""
    lines = {"a.txt": [f"1\tx\ts{i}\tq\t{i}\t{i + 1}" for i in range(3)], "b.txt": [f"2\tx\ts{i}\tq\t{i}\t{i + 1}" for i in range(3000)], "c.txt": [f"3\tx\ts{i}\tq\t{i}\t{i + 1}" for i in range(40)]}
    paths = [put(tmp_path / name, "\n".join(own) + "\n") for name, own in lines.items()]
    small = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "64"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = [(r["chrom"], r["start"]) for r in readers.read_segment_tables(spark, paths).orderBy("id").collect()]
    finally:
        for k in small:
            spark.conf.unset(k)
    assert got == [("1", i) for i in range(3)] + [("2", i) for i in range(3000)] + [("3", i) for i in range(40)]


def test_events_round_trip(spark, tmp_path):
    row = [("m_ind001", "m", 1, 1, 15, 10, 20, "a", "b", "A", "B")]
    names = "sample_id string, map string, chromosome int, event_index int, event_bp long, left_coordinate long, right_coordinate long, left_snp string, right_snp string, left_state string, right_state string"
    df = spark.createDataFrame(row, names)
    sinks.write_events(df, str(tmp_path / "ev"))
    assert readers.read_events(spark, str(tmp_path / "ev")).collect() == df.collect()
    crlf = put(tmp_path / "e.tsv", "sample_id\tchromosome\tright_state\r\nx\t1\tB\r\n")
    assert readers.read_events(spark, crlf).first()["right_state"] == "B"


def test_matrix_and_bed(spark, tmp_path):
    clean = spark.createDataFrame([("m", 1, 10, "s", "AB-")], "map string, chromosome int, coordinate long, snp_name string, genotypes string")
    sinks.write_clean_matrix(clean, str(tmp_path / "mx"))
    assert [r["value"] for r in sinks.read_clean_matrix(spark, str(tmp_path / "mx")).orderBy("line").collect()] == ["chromosome\tcoordinate\tsnp_name\tm_ind001\tm_ind002\tm_ind003", "1\t10\ts\tA\tB\t-"]
    assert sinks.matrix_header(clean).first()["header"].endswith("m_ind001\tm_ind002\tm_ind003")
    sinks.write_bed(spark.createDataFrame([("c", 5, 6, "i")], "chrom string, start long, end long, ident string"), str(tmp_path / "b"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "b")).collect()] == ["c\t5\t6\ti"]


def test_chain(spark, tmp_path):
    p = put(tmp_path / "c.chain", "chain 1 a 100 + 0 30 x 200 + 50 85 1\n10\t5\t10\n15\n\nchain 1 a 100 + 40 50 y 60 - 5 15 2\n10\n")
    got = sorted(tuple(r) for r in readers.read_chain(spark, p).collect())
    assert got == [("a", 0, 10, "x", 50, "+"), ("a", 15, 30, "x", 70, "+"), ("a", 40, 50, "y", 45, "-")]


def test_matrix_in_several_files(spark, tmp_path):
    """A map's files, one after the other in order of the manifest, are its header and its rows in order."""
    markers = spark.range(3000).selectExpr("if(id % 10 = 0, '2', '01') map", "int(id % 3) chromosome", "(id * 7919) % 3000 coordinate", "string(id) snp_name", "if(id % 10 = 0, 'AB', 'A-B') genotypes")
    markers = markers.withColumn("chromosome", markers["chromosome"] + 1).repartition(5)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    folder = str(tmp_path / "mx")
    try:
        sinks.write_clean_matrix(markers, folder)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = sinks.read_matrix_manifest(spark, folder).collect()
    assert sum(f["map"] == "01" for f in files) > 2
    got = {m: [r["value"] for r in sinks.read_clean_matrix(spark, folder).filter(f"map = '{m}'").orderBy("line").collect()] for m in ("01", "2")}
    for m, lines in got.items():
        rows = sorted((r["chromosome"], r["coordinate"], r["snp_name"], r["genotypes"]) for r in markers.filter(f"map = '{m}'").collect())
        assert lines[0].startswith("chromosome\tcoordinate\tsnp_name\t") and lines[1:] == ["\t".join([str(c), str(p), n, *g]) for c, p, n, g in rows]
        joined = []
        for f in sorted((f for f in files if f["map"] == m), key=lambda f: f["first_line"]):
            own = open(urlparse(f["file"]).path).read().splitlines()
            assert f["first_line"] == len(joined) and f["lines"] == len(own)
            joined += own
        assert joined == lines


def test_chain_against_a_loop(spark, tmp_path):
    """Chains over several files and many stretches, with and without blank lines between them, bad lines among them."""
    rng = random.Random(3)
    files, want = [], []
    for name in "ab":
        lines = ["##note", "5\t1\t1"] if name == "a" else []
        for c in range(12):
            s, t, size, strand = rng.randrange(1000), rng.randrange(1000), 10**6, rng.choice("+-")
            lines.append(f"chain 9 c{c % 4} {size} + {s} 0 t{c % 3} {size} {strand} {t} 0 {c}")
            n_lines, bad = rng.choice([0, 1, 2, 90]), rng.choice([None, None, 40])
            for i in range(n_lines):
                n, ds, dt = rng.randrange(1, 50), rng.randrange(9), rng.randrange(9)
                last = i == n_lines - 1
                lines.append(f"{n}x 1 1" if i == bad else str(n) if last else f"{n}\t{ds}\t{dt}")
                if bad is None or i < bad:
                    want.append((f"c{c % 4}", s, s + n, f"t{c % 3}", t if strand == "+" else size - t - n, strand))
                s, t = s + n + ds, t + n + dt
            lines += rng.choice([[""], [], ["# remark", ""]])
        files.append(put(tmp_path / f"{name}.chain", "\r\n".join(lines) + "\n"))
    for width in (7, 1 << 20):
        got = sorted(tuple(r) for r in readers.read_chain(spark, files, width).collect())
        assert got == sorted(want)
    assert readers.read_chain(spark, put(tmp_path / "none.chain", "# nothing\n")).count() == 0


def test_xlsx(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = '<row r="1"/><row r="3">' + "".join(cell(f"{c}3", v) for c, v in zip("ABCDE", ["raw_data", "map", "SNP_name", "chr_phy", "coordinate"], strict=True)) + "</row>"
    rows += '<row r="4">' + cell("A4", "ABABABA") + cell("B4", "m") + '<c r="C4" t="s"><v>0</v></c><c r="D4"><v>1.0</v></c><c r="E4"><v>25</v></c></row>'
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="Table_S3" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>snp</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    r = readers.read_markers(spark, str(path), "xlsx").first()
    assert (r["map"], r["snp_name"], r["chromosome"], r["coordinate"], r["genotypes"]) == ("m", "snp", "1.0", "25", "ABABABA")


def test_sheet_in_pieces(spark, tmp_path):
    """Pieces of any size give the rows that one parse of the whole sheet gives, with numbers left out, prefixed tags,
    empty rows, runs of rich text and phonetic readings."""
    rng = random.Random(8)
    for prefix in ("", "x:"):
        t = lambda tag: prefix + tag
        space = f'xmlns{":x" if prefix else ""}="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        texts = ["pad", "name", "value", *[f"s{i} &amp; &lt;row r=&quot;9&quot;&gt;" for i in range(60)]]
        strings = [f"<{t('si')}><{t('r')}><{t('t')}>{x[:2]}</{t('t')}></{t('r')}><{t('r')}><{t('t')}>{x[2:]}</{t('t')}></{t('r')}><{t('rPh')} sb='0' eb='1'><{t('t')}>no</{t('t')}></{t('rPh')}></{t('si')}>" for x in texts]
        shared = lambda n, ref="": f"<{t('c')}{ref} t='s'><{t('v')}>{n}</{t('v')}></{t('c')}>"
        rows, want, number = [f"<{t('row')} r='3'>{shared(2, ' r=\'B3\'')}{shared(1)}</{t('row')}>"], {}, 3
        for i in range(150):
            jump = rng.random() < 0.2
            number += rng.randrange(2, 5) if jump else 1
            at = f" r='{number}'" if jump else ""
            kind, n = rng.randrange(3), rng.randrange(3, 63)
            if kind == 0:
                rows.append(f"<{t('row')}{at}/>")
                want[number] = (None, None)
            elif kind == 1:
                rows.append(f"<{t('row')}{at} spans='1:3'><{t('c')} r='B{number}'><{t('v')}>{i}.5</{t('v')}></{t('c')}>{shared(n)}</{t('row')}>")
                want[number] = (f's{n - 3} & <row r="9">', f"{i}.5")
            else:
                rows.append(f"<{t('row')}{at}>{shared(n, f' r=\'C{number}\'')}</{t('row')}>")
                want[number] = (f's{n - 3} & <row r="9">', None)
        path = tmp_path / f"{len(prefix)}.xlsx"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="T" sheetId="1" r:id="i"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="i" Target="/xl/worksheets/s.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f"<{t('sst')} {space}>" + "".join(strings) + f"</{t('sst')}>")
            z.writestr("xl/worksheets/s.xml", f"<?xml version='1.0'?><{t('worksheet')} {space}><{t('sheetData')}>" + "".join(rows) + f"</{t('sheetData')}><{t('rowBreaks')}/></{t('worksheet')}>")
        for size in (150, 4 << 20):
            found = xlsx.read_sheet(spark, str(path), "T", 3, ("name", "value"), size)
            assert {r["input_ord"]: (r["name"], r["value"]) for r in found.collect()} == want
    with zipfile.ZipFile(path) as z:
        assert len(list(xlsx.pieces(z.open("xl/worksheets/s.xml"), "row", 150))) > 20
    assert xlsx.read_sheet(spark, str(path), "T", 9999).count() == 0
