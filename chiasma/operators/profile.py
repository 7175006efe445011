"""Signal around genes: flanks and bodies cut into bins, summed per window, averaged per slot.

Genes: chr, start, end, strand, input_ord. Signal: chr, start, end, value. Slots run from the upstream flank over
the body's first and last bins to the downstream flank; the gap in the middle is always empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import midpoint
from ..params import ProfileParams
from .ordered import WIDTH, stretched, within

#: Positions over which running sums of signal go on.
SUMS_WIDTH = 1 << 20


def flank_bounds(genes: DataFrame, flank: int, width: int = WIDTH) -> DataFrame:
    """low and high: how far a gene's flanks reach before the ends of earlier genes and the next gene's start.

    Genes are in order of start, end and input; the first of a chromosome is bounded by -1, the last not at all.
    """
    place = F.struct("start", "end", "input_ord")
    rows = stretched(genes, ["chr"], F.col("start"), {"ended": ("max", F.col("end")), "follows": ("next", place)}, width)
    w = within(["chr"], "start", "end", "input_ord")
    prior = F.coalesce(F.greatest("ended", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))), F.lit(-1))
    rows = rows.withColumns({"prev_end": prior, "next_start": F.coalesce(F.lead("start").over(w), F.col("follows.start"))})
    rows = rows.withColumns({"low": F.greatest(F.col("start") - flank, F.col("prev_end")), "high": F.least(F.col("end") + flank, F.col("next_start"))})
    return rows.drop("ended", "follows", "_stretch")


def tumbling_bins(spans: DataFrame, size: int, start: str = "start", end: str = "end") -> DataFrame:
    """Full bins of [start, end) from the left as (bin_l, w_l), and from the right as w_r; a remainder is dropped."""
    n = F.expr(f"greatest(({end} - {start}) div {size}, 0L)")
    rows = spans.withColumn("n_bins", n).filter("n_bins > 0").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)))
    return rows.withColumns({"left_start": F.col(start) + F.col("bin") * size, "right_start": F.col(end) - (F.col("bin") + 1) * size})


def slots(bounded: DataFrame, p: ProfileParams) -> DataFrame:
    """Windows of all genes with their slot: input_ord, chr, part, i, slot, w_start, w_end."""
    b, fb, body, right = p.bin_size, p.flank_bins, p.body_bins, p.right_offset
    counted = bounded.withColumns({
        "nl": F.greatest(F.expr(f"(start - low) div {b}"), F.lit(0).cast("long")),
        "nr": F.greatest(F.expr(f"(high - end) div {b}"), F.lit(0).cast("long")),
        "k": F.least(F.expr(f"greatest((end - start) div {b}, 0L) div 2"), F.lit(body).cast("long")),
    })
    i, plus = F.col("i"), F.col("strand") == "+"
    part = lambda name, n, w, up, down: F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>")), lambda x: F.struct(F.lit(name).alias("part"), x.alias("i"), F.when(plus, up(x)).otherwise(down(x)).cast("int").alias("slot"), w(x).alias("w_start")))
    at = F.concat(
        part("left", "nl", lambda x: F.col("low") + x * b, lambda x: fb - F.col("nl") + x, lambda x: right + F.col("nl") - 1 - x),
        part("right", "nr", lambda x: F.col("end") + x * b, lambda x: right + x, lambda x: fb - 1 - x),
        part("body_left", "k", lambda x: F.col("start") + x * b, lambda x: fb + x, lambda x: right - 1 - x),
        part("body_right", "k", lambda x: F.col("end") - (x + 1) * b, lambda x: right - 1 - x, lambda x: fb + x),
    )
    return counted.withColumn("s", F.explode(at)).select("input_ord", "chr", "s.part", "s.i", "s.slot", "s.w_start", (F.col("s.w_start") + b).alias("w_end"))


def _pieces(spans: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """Spans cut at the borders of stretches: ``keys``, _stretch, _a, _b; nearly all lie in one."""
    at = F.explode(F.sequence(F.floor(F.col(start) / F.lit(width)), F.floor((F.col(end) - 1) / F.lit(width))))
    rows = spans.filter(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("_a"), F.col(end).alias("_b"), at.alias("_stretch"))
    return rows.withColumns({"_a": F.greatest("_a", F.col("_stretch") * width), "_b": F.least("_b", (F.col("_stretch") + 1) * width)})


def window_sums(windows: DataFrame, signal: DataFrame, uniform: bool = False, width: int = SUMS_WIDTH) -> DataFrame:
    """``value`` of each window: of signal midpoints in it, or of signal spread evenly over its interval.

    No pairs are listed: signal and the edges of windows are sorted in one table, and a window is the running sum at its
    end less that at its start. Spread signal makes a sum that is linear between its ends: a slope A and an offset B,
    worth A x - B at x. Sums begin anew in each stretch of ``width`` positions, at whose borders windows and spread
    signal are cut, so a difference loses no more than the sums of one stretch can. Signal at one place is summed
    before. A window without signal counts with exactly 0; values that are null or not finite are left out.
    """
    keys = windows.columns
    s = signal.filter(~F.isnan("value") & (F.abs("value") < float("inf")))
    if uniform:
        s = _pieces(s.withColumn("w", F.col("value") / (F.col("end") - F.col("start"))), ["chr", "w"], "start", "end", width)
        base = F.col("_stretch") * width
        change = lambda pos, sign: F.struct(F.col(pos).alias("pos"), (F.col("w") * sign).alias("a"), (F.col("w") * sign * (F.col(pos) - base)).alias("b"), F.lit(sign).alias("open"))
        s = s.select("chr", "_stretch", F.explode(F.array(change("_a", 1), change("_b", -1))).alias("e")).select("chr", "_stretch", "e.*")
    else:
        s = s.select("chr", midpoint(F.col("start"), F.col("end")).alias("pos"), "value")
        s = s.select("chr", F.floor(F.col("pos") / F.lit(width)).alias("_stretch"), "pos", F.lit(0.0).alias("a"), (-F.col("value")).alias("b"), F.lit(0).alias("open"))
    s = s.groupBy("chr", "_stretch", "pos").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("open").alias("open"))
    edge = lambda pos, sign: F.struct(F.col(pos).alias("pos"), F.lit(sign).alias("sign"))
    w = _pieces(windows.select("*", F.struct(*keys).alias("_window")), ["chr", "_window"], "w_start", "w_end", width)
    w = w.select("chr", "_stretch", F.explode(F.array(edge("_a", -1), edge("_b", 1))).alias("e"), "_window").select("chr", "_stretch", "e.pos", "e.sign", "_window")
    zero = {"a": F.lit(0.0), "b": F.lit(0.0), "open": F.lit(0).cast("long")}
    rows = w.withColumns(zero | {"_n": F.lit(0)}).unionByName(s.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    # an edge comes before signal at its place: that belongs to the window that begins there
    upto = Window.partitionBy("chr", "_stretch").orderBy("pos", "_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.sum(c).over(upto) for c in ("a", "b", "open", "_n")}).filter("sign is not null")
    at = F.col("sign") * (F.col("a") * (F.col("pos") - F.col("_stretch") * width) - F.col("b"))
    touched = F.sum(F.col("sign") * F.col("_n")) + F.sum(F.when(F.col("sign") < 0, F.col("open")).otherwise(0))
    g = rows.groupBy("_window").agg(F.when(touched > 0, F.sum(at)).otherwise(0.0).alias("value"))
    return g.select("_window.*", "value")


_PARTS = ("left", "right", "body_left", "body_right")


def _windows(start, end, low, high, plus, p: ProfileParams):
    """The windows of genes (arrays), as ``slots`` gives them: the gene's number, part, i, slot and w_start."""
    import numpy as np

    b, fb, right = p.bin_size, p.flank_bins, p.right_offset
    nl, nr = np.maximum((start - low) // b, 0), np.maximum((high - end) // b, 0)
    k = np.minimum(np.maximum((end - start) // b, 0) // 2, p.body_bins)
    out = []
    for part, n in enumerate((nl, nr, k, k)):
        gene = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(gene)) - np.repeat(np.cumsum(n) - n, n)
        w = (low[gene] + i * b, end[gene] + i * b, start[gene] + i * b, end[gene] - (i + 1) * b)[part]
        up = (fb - nl[gene] + i, right + i, fb + i, right - 1 - i)[part]
        down = (right + nl[gene] - 1 - i, fb - 1 - i, right - 1 - i, fb + i)[part]
        out.append((gene, np.full(len(gene), part, np.int8), i, np.where(plus[gene], up, down), w))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


class _Signal:
    """The signal of one stretch: its changes by position, summed so that no more than a stretch's positions are held."""

    def __init__(self, base: int, uniform: bool):
        self.base, self.uniform, self.parts, self.rows = base, uniform, [], 0

    def add(self, x, y, v) -> None:
        import numpy as np

        one = np.ones(len(x))
        if self.uniform:
            self.parts += [np.stack([x - self.base, v, v * (x - self.base), one, one]), np.stack([y - self.base, -v, -v * (y - self.base), -one, one])]
        else:
            self.parts.append(np.stack([x - self.base, 0 * v, -v, 0 * one, one]))
        self.rows += len(x)
        if self.rows > SUMS_WIDTH:
            self.parts, self.rows = [self.summed()], 0

    def summed(self):
        import numpy as np

        rows = np.concatenate(self.parts, axis=1) if self.parts else np.empty((5, 0))
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        first = np.flatnonzero(np.diff(rows[0], prepend=-np.inf))
        return np.concatenate([rows[:1, first], np.add.reduceat(rows[1:], first, axis=1)]) if len(first) else rows

    def within(self):
        """A function from the begins and ends of windows to their sums."""
        import numpy as np

        rows = self.summed()
        upto = np.concatenate([np.zeros((4, 1)), np.cumsum(rows[1:], axis=1)], axis=1)

        def sums(begins, ends):
            # an edge comes before signal at its place: that belongs to the window that begins there
            (i, x), (j, y) = ((np.searchsorted(rows[0], e - self.base, side="left"), e - self.base) for e in (begins, ends))
            touched = (upto[3, j] > upto[3, i]) | (upto[2, i] > 0)
            return np.where(touched, (upto[0, j] * y - upto[1, j]) - (upto[0, i] * x - upto[1, i]), 0.0)

        return sums


def _gene_sums(p: ProfileParams, width: int, totals: bool, names: list[str]):
    """A function over batches of the signal and then the genes of each stretch: rows per window, or totals per slot."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key, signal, sums = None, None, None
        total = np.zeros((3, p.total))
        for batch in batches:
            chrom = batch.column("chr").dictionary_encode()
            code = chrom.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            stretch, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_stretch", "_kind"))
            turns = (np.diff(code) != 0) | (np.diff(stretch) != 0) | (np.diff(kind) != 0)
            edges = [0, *(np.flatnonzero(turns) + 1).tolist(), len(code)] if len(code) else []
            for a, z in zip(edges, edges[1:]):
                own = batch.slice(a, z - a)
                column = lambda c: own.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                here = (own.column("chr")[0].as_py(), int(stretch[a]))
                if here != key:
                    key, signal, sums = here, _Signal(here[1] * width, p.uniform), None
                if kind[a] == 0:
                    signal.add(column("x"), column("y"), column("v"))
                    continue
                sums = sums or signal.within()
                for at in range(0, len(own), step):
                    genes = [column(c)[at : at + step] for c in ("x", "y", "low", "high", "plus")]
                    gene, part, i, slot, w = _windows(*genes, p)
                    kept = np.flatnonzero(w // width == here[1])
                    gene, part, i, slot, w = (c[kept] for c in (gene, part, i, slot, w))
                    value = sums(w, w + p.bin_size)
                    if totals:
                        total += [np.bincount(slot, x, p.total) for x in (value, value * value, np.ones(len(w)))]
                        continue
                    part = pa.DictionaryArray.from_arrays(pa.array(part), list(_PARTS)).cast(pa.string())
                    yield pa.record_batch([own.column("input_ord").take(pa.array(gene + at)), pa.repeat(own.column("chr")[0], len(w)), part, pa.array(i), pa.array(slot, pa.int32()), pa.array(w), pa.array(w + p.bin_size), pa.array(value)], names)
        if totals:
            at = np.flatnonzero(total[2])
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at]), pa.array(total[2, at].astype(np.int64))], names)

    # genes to a batch of rows, for windows of some hundred thousand
    step = max(1, (1 << 18) // p.total)
    return run


def gene_sums(bounded: DataFrame, signal: DataFrame, p: ProfileParams, totals: bool = False, width: int = SUMS_WIDTH) -> DataFrame:
    """``window_sums`` of the ``slots`` of all genes; with ``totals`` slot, s, q, n: partial sums of the values, of their
    squares and of one.

    Genes are shuffled, not their windows, of which a gene has up to a row per slot. A gene goes to each stretch in which
    windows of it may begin, signal also to the stretch before if it lies within a window's length of its own begin, so each
    window is had whole in one stretch. A task holds the signal of one stretch, summed by position; genes stream by.
    """
    b = p.bin_size
    width = max(width, b)
    floor = lambda x: F.floor(x / F.lit(width))
    x, y = F.coalesce("start", "end"), F.coalesce("end", "start")
    low, high = F.when(F.col("start").isNull(), y).otherwise(F.col("low")), F.when(F.col("end").isNull(), x).otherwise(F.col("high"))
    none = F.lit(None)
    genes = bounded.filter(x.isNotNull()).select("chr", "input_ord", x.alias("x"), y.alias("y"), low.alias("low"), high.alias("high"), (F.col("strand") == "+").alias("plus"))
    genes = genes.select("*", F.explode(F.sequence(floor(F.least("low", "x", "y")), floor(F.greatest("high", "x", "y")))).alias("_stretch"))
    genes = genes.select("chr", "_stretch", F.lit(1).alias("_kind"), "x", "y", none.cast("double").alias("v"), "low", "high", F.coalesce("plus", F.lit(False)).alias("plus"), "input_ord")
    s = signal.filter(F.col("chr").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    if p.uniform:
        s = s.filter("end > start").select("chr", F.col("start").alias("x"), F.col("end").alias("y"), (F.col("value") / (F.col("end") - F.col("start"))).alias("v"))
        last = F.col("y") - 1
    else:
        s = s.select("chr", midpoint(F.col("start"), F.col("end")).alias("x"), F.col("value").alias("v")).filter("x is not null").withColumn("y", F.col("x"))
        last = F.col("x")
    s = s.select("*", F.explode(F.sequence(floor(F.col("x") - b), floor(last))).alias("_stretch"))
    if p.uniform:
        s = s.withColumns({"x": F.greatest("x", F.col("_stretch") * width), "y": F.least("y", (F.col("_stretch") + 1) * width + b)}).filter("y > x")
    s = s.select("chr", "_stretch", F.lit(0).alias("_kind"), "x", "y", "v", *[none.cast("long").alias(c) for c in ("low", "high")], none.cast("boolean").alias("plus"), none.cast(bounded.schema["input_ord"].dataType).alias("input_ord"))
    rows = s.unionByName(genes).repartition("chr", "_stretch").sortWithinPartitions("chr", "_stretch", "_kind")
    kind = lambda c: bounded.schema[c].dataType.simpleString()
    schema = "slot int, s double, q double, n bigint" if totals else f"input_ord {kind('input_ord')}, chr {kind('chr')}, part string, i bigint, slot int, w_start bigint, w_end bigint, value double"
    return rows.mapInArrow(_gene_sums(p, width, totals, [c.split()[0] for c in schema.split(", ")]), schema)


def profile(genes: DataFrame, signal: DataFrame, p: ProfileParams) -> DataFrame:
    """slot, mean, se (population), n of all slots; null where no window falls."""
    parts = gene_sums(flank_bounds(genes, p.flanking_bp), signal, p, totals=True)
    g = parts.groupBy("slot").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    spine = genes.sparkSession.range(p.total).select(F.col("id").cast("int").alias("slot"))
    g = spine.join(F.broadcast(g), "slot", "left")  # one row a slot at most
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
    return g.select("slot", mean.alias("mean"), F.sqrt(var / F.col("n")).alias("se"), F.coalesce("n", F.lit(0)).alias("n"))


def ticks(p: ProfileParams) -> list[tuple[int, str]]:
    """Slots and labels of the profile's axis: quarters of both flanks and the body's ends; of equal successive slots the first."""
    kb = lambda x: f"{int(x)} kb" if x == int(x) else f"{x:g} kb"
    flank, n, right = p.flanking_bp / 1000, p.flank_bins, p.right_offset
    out = [(q * n // 4, f"-{kb(flank * (4 - q) / 4)}") for q in range(4)] + [(n, "TSS"), (right, "TTS")]
    out += [(right + q * n // 4, f"+{kb(flank * q / 4)}") for q in range(1, 4)] + [(p.total - 1, f"+{kb(flank)}")]
    return [t for i, t in enumerate(out) if not i or out[i - 1][0] != t[0]]
