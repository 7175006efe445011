"""Two-state Viterbi per (map, sample, chromosome), and crossover events from its paths.

No row or task memory holds a chromosome. Markers come in stretches of bounded size (``stretches``):

- Forward: the stretches of a (map, chromosome, 64 samples) pass through a task in order as a stream; from one to the
  next go two scores a sample. A stretch leaves its back-pointers as two bits a marker and sample, and what they come to
  together: the state before the stretch as a function of the state at its end.
- Back: such functions are composed from the last stretch to the first over that small table alone, two longs a stretch.
- Trace: each stretch is then traced from its own end state, in any task.

The scores are not combined as max-plus matrices of stretches, though those are associative: two paths of equal
probability (equal distances around a missing genotype) are told apart by the rounding of the sums from left to right,
and sums in another order tell them apart otherwise. Exact sums changed 44 of 2,008, 1 of 2,250 and 50 of 2,250 paths
on three sets. The functions of states have no rounding, so they are combined freely. Ties go to state 0 (A).
For the same reason logarithms are the C library's (``math.log``): the JVM's differ in the last bit for some distances.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.scalars import midpoint, sample_id, state_label, switch_probability
from ..params import HmmParams
from ..sources.shared import stored
from .ordered import WIDTH
from .stretches import KEYS, SAMPLES, STRETCH, marker_stretches

FULL = (1 << SAMPLES) - 1
_GROUP = KEYS[:3]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forward(logs: dict[str, float]):
    """A function over batches of stretches in order: back-pointers, and the state before each stretch by that at its end.

    ``logs``: of one half, and of what each state shows. Longs hold a bit a sample.
    """

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = np.empty((2, 256))
        table[:] = logs["missing"]
        for state, shown in ((0, "AB"), (1, "BA")):
            table[state, ord(shown[0])], table[state, ord(shown[1])] = logs["match"], logs["mismatch"]
        names = [*KEYS, "to0", "to1", "from0", "from1", "top"]
        scores = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                m, n = len(row["genotypes"]), row["n"]
                seen = np.frombuffer("".join(g.ljust(n, "-")[:n] for g in row["genotypes"]).encode("ascii", "replace"), np.uint8).reshape(m, n)
                shown = np.ascontiguousarray(table[:, seen].transpose(1, 0, 2))
                back = np.zeros((2, m, SAMPLES), bool)
                start = 0
                if row["stretch"] == 0:
                    scores = logs["half"] + shown[0]
                    back[1, 0] = True
                    start = 1
                b0, b1 = back[0, :, :n], back[1, :, :n]
                stays, goes = [math.log(1 - x) for x in row["switch"]], [math.log(x) for x in row["switch"]]
                for i in range(start, m):
                    stay, come = scores + stays[i], scores[::-1] + goes[i]
                    np.greater(come[0], stay[0], out=b0[i])
                    np.greater(stay[1], come[1], out=b1[i])
                    scores = np.maximum(stay, come)
                    scores += shown[i]
                to0, to1 = (np.packbits(b, axis=1, bitorder="little").view("<u8")[:, 0] for b in back)
                from0, from1 = 0, FULL
                for x, y in zip(to0.tolist(), to1.tolist(), strict=True):
                    from0, from1 = (x & from1) | (~x & from0), (y & from1) | (~y & from0)
                top = sum(1 << int(j) for j in np.flatnonzero(scores[1] > scores[0]))
                out.append((*(row[k] for k in KEYS), to0.tobytes(), to1.tobytes(), _signed(from0 & FULL), _signed(from1 & FULL), _signed(top)))
            if out:
                kinds = [*(batch.schema.field(k).type for k in KEYS), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names)

    return run


def _end_states(batches: Iterable) -> Iterator:
    """Of each stretch, from the last of its group back: the states at its end."""
    import pyarrow as pa

    group, state = None, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if group != tuple(row[k] for k in _GROUP):
                group, state = tuple(row[k] for k in _GROUP), row["top"]
            out.append((*(row[k] for k in KEYS), state))
            state = (row["from1"] & state) | (row["from0"] & ~state)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [*(batch.schema.field(k).type for k in KEYS), pa.int64()], strict=True)], [*KEYS, "state_at_end"])


def viterbi(clean: DataFrame, p: HmmParams = HmmParams(), size: int = STRETCH, width: int = WIDTH) -> DataFrame:
    """The stretches with their back-pointers and ``state_at_end``."""
    rows = stored(marker_stretches(stored(clean.select("map", "chromosome", "coordinate", "snp_name", "genotypes"), "hmm-markers"), size, width), "hmm-stretches")
    logs = {"half": math.log(0.5), "match": math.log(p.match), "mismatch": math.log(p.mismatch), "missing": math.log(p.missing)}
    switch = F.transform("markers", lambda m: switch_probability(m["coordinate"] - m["left_coordinate"], p))
    steps = rows.select(*KEYS, "n", F.transform("markers", lambda m: m["genotypes"]).alias("genotypes"), switch.alias("switch"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*KEYS).schema)
    ordered = steps.repartition(*_GROUP).sortWithinPartitions(*KEYS)
    traced = stored(ordered.mapInArrow(_forward(logs), f"{kinds}, to0 binary, to1 binary, from0 bigint, from1 bigint, top bigint"), "hmm-forward")
    back = traced.select(*KEYS, "from0", "from1", "top").repartition(*_GROUP).sortWithinPartitions(*_GROUP, F.col("stretch").desc())
    ends = back.mapInArrow(_end_states, f"{kinds}, state_at_end bigint")
    return rows.join(traced.select(*KEYS, "to0", "to1").join(ends, KEYS), KEYS)


def _states(to0: bytes, to1: bytes, end: int, n: int) -> list[int]:
    """The states (a bit a sample) at each marker of a stretch and, first, before it."""
    import numpy as np

    full = (1 << n) - 1
    state, out = end & full, []
    for x, y in zip(np.frombuffer(to0, "<u8")[::-1].tolist(), np.frombuffer(to1, "<u8")[::-1].tolist(), strict=True):
        out.append(state)
        state = (y & state) | (x & ~state & full)
    return [state, *reversed(out)]


def path_strings(paths: DataFrame) -> DataFrame:
    """map, chromosome, dense_idx, ``path``: one character 0 or 1 a marker."""

    @pandas_udf("array<string>")
    def texts(to0: pd.Series, to1: pd.Series, end: pd.Series, n: pd.Series) -> pd.Series:
        def of(x0, x1, e, k):
            rows = [format(s, f"0{k}b") for s in _states(x0, x1, e, k)[1:]]
            return ["".join(c) for c in zip(*rows, strict=True)][::-1]

        return pd.Series([of(*x) for x in zip(to0, to1, end, n, strict=True)])

    rows = paths.select(*KEYS, F.posexplode(texts("to0", "to1", "state_at_end", "n")).alias("at", "text"))
    rows = rows.groupBy("map", "chromosome", (F.col("block") * SAMPLES + F.col("at")).cast("int").alias("dense_idx")).agg(F.array_sort(F.collect_list(F.struct("stretch", "text"))).alias("parts"))
    return rows.select("map", "chromosome", "dense_idx", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("path"))


def state_changes(paths: DataFrame) -> DataFrame:
    """One row per change of state along a path; a change at the first marker of a stretch has its left marker in the one before."""

    @pandas_udf("array<struct<at:int,i:int,state:int>>")
    def changes(to0: pd.Series, to1: pd.Series, end: pd.Series, n: pd.Series) -> pd.Series:
        def of(x0, x1, e, k):
            states, out = _states(x0, x1, e, k), []
            for i, (a, b) in enumerate(zip(states, states[1:])):
                x = a ^ b
                while x:
                    j = (x & -x).bit_length() - 1
                    out.append({"at": j, "i": i, "state": b >> j & 1})
                    x &= x - 1
            return out

        return pd.Series([of(*x) for x in zip(to0, to1, end, n, strict=True)])

    rows = paths.select("map", "chromosome", "block", "markers", F.explode(changes("to0", "to1", "state_at_end", "n")).alias("c"))
    marker = lambda name: F.get("markers", F.col("c.i"))[name]
    rows = rows.select(
        "map", "chromosome", (F.col("block") * SAMPLES + F.col("c.at")).cast("int").alias("dense_idx"),
        marker("left_coordinate").alias("left_coordinate"), marker("coordinate").alias("right_coordinate"), marker("left_snp").alias("left_snp"), marker("snp").alias("right_snp"),
        state_label(1 - F.col("c.state")).alias("left_state"), state_label(F.col("c.state")).alias("right_state"),
    )
    return rows.withColumn("event_bp", midpoint(F.col("left_coordinate"), F.col("right_coordinate")))


def collapse_close_pairs(events: DataFrame, keys: list[str], pos: str, distance: int) -> DataFrame:
    """Greedy removal of close pairs: going right, two neighbours within ``distance`` both go.

    Within an island of events linked by such gaps pairs are removed from the left, so what stays is the last
    event of an island of odd length.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    rows = events.withColumn("_new", F.when(F.col(pos) - F.lag(pos).over(w) <= distance, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "_island").orderBy(pos)
    rows = rows.withColumns({"_r": F.row_number().over(inner), "_last": F.lead("_new").over(inner).isNull()})
    return rows.filter((F.col("_r") % 2 == 1) & F.col("_last")).drop("_new", "_island", "_r", "_last")


def numbered_events(events: DataFrame) -> DataFrame:
    """The event table: sample ids, and event_index along each sample over its chromosomes."""
    w = Window.partitionBy("map", "dense_idx").orderBy("chromosome", "event_bp")
    rows = events.withColumns({"event_index": F.row_number().over(w), "sample_id": sample_id(F.col("map"), F.col("dense_idx"))})
    return rows.select("sample_id", "map", "chromosome", "event_index", "event_bp", "left_coordinate", "right_coordinate", "left_snp", "right_snp", "left_state", "right_state")


def call_events(clean: DataFrame, p: HmmParams = HmmParams()) -> DataFrame:
    changes = state_changes(viterbi(clean, p))
    return numbered_events(collapse_close_pairs(changes, ["map", "dense_idx", "chromosome"], "event_bp", p.close_bp))
