"""The four workflows from inputs to tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sample_id
from ..operators import genmap, genotypes, hmm, liftover, marey, profile, sampling, switches
from ..operators.intervals import endpoints, rebuild_intervals
from ..params import CleaningParams, HmmParams, ProfileParams, SimulationParams, SwitchParams
from ..sources.shared import stored


@dataclass
class CrossoverCalls:
    clean: DataFrame
    events: DataFrame
    qc: DataFrame


def call_crossovers(raw: DataFrame, cleaning: CleaningParams = CleaningParams(), model: HmmParams = HmmParams()) -> CrossoverCalls:
    """From raw markers to cleaned matrices, crossover events and one quality row a map."""
    rows = genotypes.required(raw, cleaning)
    staged, kept = (stored(t, "cleaning") for t in genotypes.staged(rows, cleaning))
    clean = genotypes.final(staged)
    events = stored(hmm.call_events(clean, model), "events")
    return CrossoverCalls(clean, events, genotypes.qc_summary(rows, staged, kept, events))


def call_switches(raw: DataFrame, cleaning: CleaningParams = CleaningParams(), p: SwitchParams = SwitchParams()) -> tuple[DataFrame, DataFrame]:
    """Raw and filtered calls without a model."""
    rows = genotypes.required(raw, cleaning)
    named = lambda calls: calls.withColumn("sample_id", sample_id(F.col("map"), F.col("sample_idx")))
    return named(switches.raw_calls(rows)), named(switches.filtered_calls(rows, p))


def metaplot(genes: DataFrame, signal: DataFrame, p: ProfileParams) -> DataFrame:
    return profile.profile(genes, signal, p)


def simulate_regions(genes: DataFrame, chroms: DataFrame, intervals: DataFrame, p: SimulationParams = SimulationParams()) -> DataFrame:
    return sampling.simulate(genes, chroms, intervals, p)


def marey_map(events: DataFrame) -> DataFrame:
    return marey.marey_curve(events)


def united(tables: list[DataFrame]) -> DataFrame:
    """Interval tables of several sources as one: chrom, start, end, sample, id."""
    out, *rest = (t.select("chrom", "start", "end", "sample", "id") for t in tables)
    for t in rest:
        out = out.unionByName(t)
    return out


def lifted_intervals(intervals: DataFrame, blocks: DataFrame) -> DataFrame:
    """Intervals moved by their end points: those whose two points each land once, on one chromosome."""
    return rebuild_intervals(liftover.lift_points(endpoints(intervals), blocks))


def fine_map(intervals: DataFrame, markers: DataFrame, lengths: DataFrame) -> DataFrame:
    """Intervals with genetic positions and rates. Markers: chrom, bp, cm."""
    return genmap.annotate(intervals, genmap.anchored(markers, lengths))
