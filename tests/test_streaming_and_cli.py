"""Streams over files, the command line, and the driver's entry module."""

import datetime as dt

from chiasma.__main__ import main, parser
from chiasma.streaming import live


def test_streams(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    rows = [("a", at(0), 1), ("a", at(4), 2), ("a", at(6), 3), ("b", at(7), 4), ("a", at(20), 5), ("b", at(300), 6)]
    spark.createDataFrame(rows, "k string, ts timestamp, v long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, v long").parquet(str(tmp_path / "in"))
    live.run_available(live.tumbling_counts(stream, "ts", ["k"], "5 minutes", "1 minute", "v"), str(tmp_path / "t"), str(tmp_path / "c1"))
    got = sorted((r["k"], r["start"].minute, r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert got == [("a", 0, 2, 3), ("a", 5, 1, 3), ("a", 20, 1, 5), ("b", 5, 1, 4)]
    live.run_available(live.gap_sessions(stream, "ts", ["k"], "10 minutes", "1 minute"), str(tmp_path / "s"), str(tmp_path / "c2"))
    got = sorted((r["k"], r["n"]) for r in spark.read.parquet(str(tmp_path / "s")).collect())
    assert got == [("a", 1), ("a", 3), ("b", 1)]


def test_command_line(spark, tmp_path):
    (tmp_path / "g.gff").write_text("chr1\ts\tgene\t101\t400\t.\t+\t.\tx\n")
    (tmp_path / "s.bed").write_text("chr1\t120\t121\t3\n")
    args = ["metaplot", "--gff", str(tmp_path / "g.gff"), "--input", str(tmp_path / "s.bed"), "--bin-size", "10", "--flanking-bp", "50", "--body-bins", "3", "--output", str(tmp_path / "out")]
    main(args)
    rows = spark.read.csv(str(tmp_path / "out"), header=True).collect()
    assert len(rows) == 2 * 5 + 2 * 3 + 5 and sum(float(r["mean"] or 0) for r in rows) == 3
    assert parser().parse_args(["marey"]).input == parser().parse_args(["switches", "--input", "x"]).output + "/co_events_long"  # what switches writes


def test_entry_module(spark):
    import __spark_entry__ as e

    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 45
    assert e.entry(spark).count() > 0
