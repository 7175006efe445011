"""Command line: ``python -m chiasma call|switches|metaplot|simulate|marey|lift|fine-map``. Figures are written as their data."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .operators import profile
from .params import ProfileParams, SimulationParams
from .plans import workflows
from .sources import readers, sinks

log = logging.getLogger("chiasma")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chiasma")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("call", "switches"):
        c = sub.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--format", default="xlsx", choices=["xlsx", "csv", "parquet"])
        c.add_argument("--output", default="results")
    m = sub.add_parser("metaplot")
    for name in ("--gff", "--input"):
        m.add_argument(name, required=True)
    for name in ("--bin-size", "--flanking-bp", "--body-bins"):
        m.add_argument(name, type=int, required=True)
    m.add_argument("--uniform", action="store_true")
    m.add_argument("--no-show", action="store_true", help="accepted; nothing is shown")
    m.add_argument("--output", default="metaplot_data")
    m.add_argument("--title", default="")
    s = sub.add_parser("simulate")
    for name in ("--fai", "--gff", "--intervals"):
        s.add_argument(name, required=True)
    s.add_argument("--output", default="simulated")
    s.add_argument("--regions", type=int, default=SimulationParams.regions)
    s.add_argument("--seed", type=int, default=SimulationParams.seed)
    y = sub.add_parser("marey")
    y.add_argument("input", nargs="?", default="results/co_events_long")
    y.add_argument("output", nargs="?", default="results/marey_map_data")
    t = sub.add_parser("lift", help="unite interval tables, move them to another assembly and rebuild them")
    t.add_argument("--chain", required=True)
    t.add_argument("--output", required=True)
    for name, what in (("--segments", "segment tables"), ("--crossovers", "crossover tables"), ("--events", "event tables of call or switches"), ("--bed", "BED with sample and id")):
        t.add_argument(name, nargs="*", default=[], help=what)
    f = sub.add_parser("fine-map")
    for name in ("--intervals", "--map", "--fai", "--output"):
        f.add_argument(name, required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    a = parser().parse_args(argv)
    params = ProfileParams(a.bin_size, a.flanking_bp, a.body_bins, a.uniform) if a.command == "metaplot" else None
    spark = SparkSession.builder.appName("chiasma").getOrCreate()
    if a.command == "call":
        out = workflows.call_crossovers(readers.read_markers(spark, a.input, a.format))
        sinks.write_clean_matrix(out.clean, f"{a.output}/hmm_cleaned_matrices")
        sinks.write_events(out.events, f"{a.output}/hmm_co_events_long")
        sinks.write_qc_summary(out.qc, f"{a.output}/hmm_qc_summary")
        n = readers.read_events(spark, f"{a.output}/hmm_co_events_long").count()
        log.info("%d crossover intervals called", n)
    elif a.command == "switches":
        raw, kept = workflows.call_switches(readers.read_markers(spark, a.input, a.format))
        for name, rows in (("co_events_long", raw), ("co_events_long_filtered", kept)):
            rows.write.mode("overwrite").csv(f"{a.output}/{name}", sep="\t", header=True)
    elif a.command == "metaplot":
        for r in readers.renamed_chromosomes(spark, a.gff).collect():
            log.warning("chromosome %s read as %s", r["name"], r["chrom"])
        sinks.write_plot_data(workflows.metaplot(readers.read_genes(spark, a.gff), readers.read_signal(spark, a.input), params), a.output)
        for slot, label in profile.ticks(params):
            log.info("tick %d: %s", slot, label)
    elif a.command == "simulate":
        chroms = readers.read_lengths(spark, a.fai)
        rows = workflows.simulate_regions(readers.read_gene_spans(spark, a.gff, chroms), chroms, readers.read_intervals(spark, a.intervals), SimulationParams(regions=a.regions, seed=a.seed))
        rows = rows.cache()
        for kind in ("uniform", "five_prime", "body", "three_prime"):
            sinks.write_bed(rows.filter(rows["set"] == kind), f"{a.output}/{kind}")
        rows.unpersist()
    elif a.command == "marey":
        sinks.write_plot_data(workflows.marey_map(readers.read_events(spark, a.input)), a.output)
    elif a.command == "lift":
        found = [read(spark, paths) for read, paths in ((readers.read_segment_tables, a.segments), (readers.read_crossover_tables, a.crossovers)) if paths]
        found += [readers.event_intervals(readers.read_events(spark, path)) for path in a.events] + [readers.read_intervals(spark, path) for path in a.bed]
        if not found:
            raise SystemExit("lift needs a table of intervals")
        moved = workflows.lifted_intervals(workflows.united(found), readers.read_chain(spark, a.chain))
        sinks.write_bed(moved, a.output, ("chrom", "start", "end", "sample", "id"))
    else:
        markers = readers.read_map_markers(spark, a.map).withColumnRenamed("start", "bp").select("chrom", "bp", "cm")
        rows = readers.read_intervals(spark, a.intervals).withColumnRenamed("id", "marker")
        workflows.fine_map(rows, markers, readers.read_lengths(spark, a.fai)).write.mode("overwrite").csv(a.output, sep="\t")
    log.info("wrote %s", a.output)


if __name__ == "__main__":
    main()
