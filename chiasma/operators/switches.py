"""Crossovers called from changes between informative markers, without a model.

Runs form a monoid: those of a stretch of markers (``stretches``) are read off its row for all samples at once, without a row
per genotype, and runs of neighbouring stretches join where the last of one and the first of the next have one state. A
window over the runs of a sample does that; nothing is collected beyond a stretch. Markers at one place are in order of
name, then of genotypes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import midpoint
from ..params import SwitchParams
from ..sources.shared import stored
from .hmm import collapse_close_pairs
from .ordered import WIDTH
from .stretches import SAMPLES, STRETCH, marker_stretches

_SAMPLE = ["map", "sample_idx", "chromosome"]


_RUN = ["map", "sample_idx", "chromosome", "stretch", "part", "state", "n_markers", "first_coordinate", "last_coordinate", "first_snp", "last_snp"]


def _stretch_runs(batches: Iterable) -> Iterator:
    """Of rows of markers the runs of each sample within them."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for r, n in enumerate(batch.column("n").to_pylist()):
            markers = batch.column("markers")[r].values
            coordinates, snps = markers.field("coordinate"), markers.field("snp")
            seen = np.frombuffer("".join(g.ljust(n, "-")[:n] for g in markers.field("genotypes").to_pylist()).encode("ascii", "replace"), np.uint8)
            seen = seen.reshape(len(markers), n).T
            sample, i = np.nonzero((seen == 65) | (seen == 66))  # sample after sample, each in order of its markers
            if not len(i):
                continue
            state = seen[sample, i]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(sample) != 0) | (state[1:] != state[:-1])]))
            size = np.diff(first, append=len(i))
            whose, start, end = sample[first], pa.array(i[first]), pa.array(i[first + size - 1])
            part = np.arange(len(first)) - np.searchsorted(whose, whose)
            own = lambda c: pa.repeat(batch.column(c)[r], len(first))  # noqa: B023, E731
            yield pa.record_batch(
                [
                    own("map"), pa.array(batch.column("block")[r].as_py() * SAMPLES + whose, pa.int32()), own("chromosome"), own("stretch"), pa.array(part, pa.int32()),
                    pa.array(np.where(state[first] == 65, "A", "B"), pa.string()), pa.array(size, pa.int64()), coordinates.take(start), coordinates.take(end), snps.take(start), snps.take(end),
                ],
                _RUN,
            )


def runs(markers: DataFrame, size: int = STRETCH, width: int = WIDTH) -> DataFrame:
    """Runs of equal informative states: state, n_markers, first and last marker, span."""
    return _runs_table(markers, size, width).drop("left_coordinate", "left_snp", "left_state")


def _runs_table(markers: DataFrame, size: int = STRETCH, width: int = WIDTH) -> DataFrame:
    """The runs of each stretch, joined where neighbours of one sample have the same state."""
    markers = stored(markers.select("map", "chromosome", "coordinate", "snp_name", "genotypes"), "switch-markers")  # read twice
    rows = marker_stretches(markers, size, width)
    kind = lambda c: rows.schema[c].dataType.simpleString()
    of = lambda c: markers.schema[c].dataType.simpleString()
    schema = f"map {kind('map')}, sample_idx int, chromosome {kind('chromosome')}, stretch {kind('stretch')}, part int, state string, n_markers bigint, first_coordinate {of('coordinate')}, last_coordinate {of('coordinate')}, first_snp {of('snp_name')}, last_snp {of('snp_name')}"
    rows = rows.mapInArrow(_stretch_runs, schema)
    w = Window.partitionBy(*_SAMPLE).orderBy("stretch", "part")
    prior = {f"left_{name}": F.lag(of).over(w) for name, of in (("coordinate", "last_coordinate"), ("snp", "last_snp"), ("state", "state"))}
    rows = rows.withColumns(prior).withColumn("opens", F.when(F.col("left_state") == F.col("state"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    place = F.struct("stretch", "part")
    first = lambda name, of: F.min_by(of, place).alias(name)
    last = lambda name, of: F.max_by(of, place).alias(name)
    g = rows.groupBy(*_SAMPLE, "run").agg(
        first("state", "state"), F.sum("n_markers").alias("n_markers"), first("first_coordinate", "first_coordinate"), last("last_coordinate", "last_coordinate"),
        first("first_snp", "first_snp"), last("last_snp", "last_snp"), first("left_coordinate", "left_coordinate"), first("left_snp", "left_snp"), first("left_state", "left_state"),
    )
    return g.withColumn("span", F.col("last_coordinate") - F.col("first_coordinate"))


def _calls(runs: DataFrame) -> DataFrame:
    """A call at the beginning of each run but a sample's first."""
    rows = runs.filter(F.col("left_state").isNotNull())
    return rows.select(*_SAMPLE, midpoint(F.col("left_coordinate"), F.col("first_coordinate")).alias("event_bp"), "left_coordinate", F.col("first_coordinate").alias("right_coordinate"), "left_snp", F.col("first_snp").alias("right_snp"), "left_state", F.col("state").alias("right_state"))


def raw_calls(markers: DataFrame) -> DataFrame:
    """A call wherever two successive informative markers of a sample differ."""
    return _calls(_runs_table(markers))


def filtered_calls(markers: DataFrame, p: SwitchParams = SwitchParams()) -> DataFrame:
    """Changes into runs of enough markers and length, close pairs removed.

    The left marker is the last of the run before, whatever that run's length; runs that fail are not merged away.
    """
    rows = _runs_table(markers).filter((F.col("n_markers") >= p.min_run_markers) & (F.col("span") >= p.min_run_bp))
    return collapse_close_pairs(_calls(rows), _SAMPLE, "event_bp", p.close_bp)
