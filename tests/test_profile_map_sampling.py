"""Profiles, genetic maps, lift-over and sampling."""

import hashlib
import random

import numpy as np
import pytest

from chiasma.operators import asof, genmap, liftover, profile, sampling
from chiasma.params import ProfileParams, SimulationParams

GENES = "chr string, start long, end long, strand string, input_ord long"


def test_parameters_are_checked():
    for bad in ((0, 10, 1), (10, -10, 1), (10, 15, 1), (10, 20, 0)):
        with pytest.raises(ValueError):
            ProfileParams(*bad)
    assert ProfileParams(100, 1000, 25).total == 75


def loop_profile(genes, signal, p):
    b, fb, right = p.bin_size, p.flank_bins, p.right_offset
    got = {s: [] for s in range(p.total)}
    for chrom in {g[0] for g in genes}:
        own = sorted((g for g in genes if g[0] == chrom), key=lambda g: (g[1], g[2], g[4]))
        reach = -1
        for i, (_, s, e, strand, _) in enumerate(own):
            low = max(s - p.flanking_bp, reach)
            high = min(e + p.flanking_bp, own[i + 1][1]) if i + 1 < len(own) else e + p.flanking_bp
            reach = max(reach, e)
            left = [(low + j * b, low + (j + 1) * b) for j in range(max(0, (s - low) // b))]
            after = [(e + j * b, e + (j + 1) * b) for j in range(max(0, (high - e) // b))]
            n = min(((e - s) // b) // 2, p.body_bins)
            head, tail = [(s + j * b, s + (j + 1) * b) for j in range(n)], [(e - (j + 1) * b, e - j * b) for j in range(n)]
            up, down, first, last = (left, after, head, tail) if strand == "+" else (after[::-1], left[::-1], tail, head)
            place = [(fb - len(up) + j, w) for j, w in enumerate(up)] + [(right + j, w) for j, w in enumerate(down)]
            place += [(fb + j, w) for j, w in enumerate(first)] + [(right - 1 - j, w) for j, w in enumerate(last)]
            for slot, (a, z) in place:
                got[slot].append(sum(v for c, x, y, v in signal if c == chrom and a <= (x + y) // 2 < z))
    return got


def test_profile_matches_loop(spark):
    rng = random.Random(3)
    genes = [(rng.choice(["c1", "c2", "dark"]), a := rng.randrange(3000), a + rng.randrange(5, 300), rng.choice("+-"), i) for i in range(40)]
    genes += [("c1", 700, 760, "+", 50), ("c1", 700, 760, "-", 51)]
    signal = [(rng.choice(["c1", "c2"]), a := rng.randrange(3300), a + rng.randrange(0, 30), float(rng.randrange(9))) for _ in range(300)]
    p = ProfileParams(10, 60, 4)
    df = profile.profile(spark.createDataFrame(genes, GENES), spark.createDataFrame(signal, "chr string, start long, end long, value double"), p)
    want = loop_profile(genes, signal, p)
    rows = {r["slot"]: r for r in df.collect()}
    assert len(rows) == p.total
    for slot, values in want.items():
        r = rows[slot]
        assert r["n"] == len(values)
        if values:
            assert abs(r["mean"] - np.mean(values)) < 1e-9 and abs(r["se"] - np.std(values) / len(values) ** 0.5) < 1e-9
        else:
            assert r["mean"] is None and r["se"] is None


@pytest.mark.parametrize("uniform", [False, True])
def test_window_sums_over_seams(spark, uniform):
    """Windows and signal across stretches, signal over several of them, many rows at one place, values that do not count."""
    rng = random.Random(12)
    signal = [("c", a := rng.randrange(2000), a + rng.choice((0, 1, 5, 60, 700)), rng.random() * 10 - 3) for _ in range(150)]
    signal += [("c", 500, 502, 1.5)] * 80 + [("c", 0, 2500, 7.0), ("c", 10, 20, None), ("c", 10, 20, float("nan")), ("c", 30, 31, float("inf")), ("d", 5, 9, 2.0)]
    windows = [("c", i, a := rng.randrange(2400), a + rng.choice((1, 10, 100, 333))) for i in range(120)] + [("c", 200, 9000, 9100), ("d", 201, 9, 20), ("e", 202, 0, 5), ("d", 203, 7, 8)]
    df = profile.window_sums(spark.createDataFrame(windows, "chr string, i int, w_start long, w_end long"), spark.createDataFrame(signal, "chr string, start long, end long, value double"), uniform, width=64)
    got = {r["i"]: r["value"] for r in df.collect()}
    assert len(got) == len(windows)
    for c, i, a, b in windows:
        own = [(x, y, v) for k, x, y, v in signal if k == c and v is not None and abs(v) < float("inf")]
        want = sum(v * max(0, min(b, y) - max(a, x)) / (y - x) for x, y, v in own if y > x) if uniform else sum(v for x, y, v in own if a <= (x + y) // 2 < b)
        assert abs(got[i] - want) < 1e-9
    assert got[200] == got[201] == got[202] == 0


@pytest.mark.parametrize("uniform", [False, True])
def test_gene_sums_over_seams(spark, uniform):
    """Genes and signal across stretches against all windows and all signal; what is shuffled is a row a gene, not a window."""
    rng = random.Random(14)
    genes = [(rng.choice(["c", "d", "dark"]), a := rng.randrange(4000), a + rng.choice((0, 5, 40, 300, 1500)), rng.choice(["+", "-", None]), i) for i in range(60)]
    genes += [(None, 5, 90, "+", 60), ("c", None, 70, "+", 61), ("c", 80, None, "-", 62)]
    signal = [(rng.choice(["c", "d"]), a := rng.randrange(-50, 4500), a + rng.choice((0, 1, 7, 60, 900)), rng.random() * 10 - 3) for _ in range(300)]
    signal += [("c", 500, 502, 1.5)] * 80 + [("c", 0, 2500, 7.0), ("c", 10, 20, None), ("c", 10, 20, float("nan")), ("c", 30, 31, float("inf")), (None, 5, 9, 2.0), ("c", None, 9, 2.0)]
    p = ProfileParams(10, 60, 4, uniform)
    bounded = profile.flank_bounds(spark.createDataFrame(genes, GENES), p.flanking_bp)
    rows = spark.createDataFrame(signal, "chr string, start long, end long, value double")
    slots = profile.slots(bounded, p)
    for width in (64, 10, 1 << 20):
        df = profile.gene_sums(bounded, rows, p, width=width)
        assert df.columns == [*slots.columns, "value"] and [f.dataType for f in df.schema][:-1] == [f.dataType for f in slots.schema]
        got = [tuple(r) for r in df.collect()]
        assert sorted((g[:-1] for g in got), key=str) == sorted(map(tuple, slots.collect()), key=str)
        for g in got:
            own = [(x, y, v) for k, x, y, v in signal if k is not None and k == g[1] and x is not None and v is not None and abs(v) < float("inf")]
            a, b = g[5], g[6]
            want = sum(v * max(0, min(b, y) - max(a, x)) / (y - x) for x, y, v in own if y > x) if uniform else sum(v for x, y, v in own if a <= (x + y) // 2 < b)
            assert abs(g[7] - want) < 1e-9
        sums = {r["slot"]: r for r in profile.gene_sums(bounded, rows, p, True, width).groupBy("slot").sum("s", "q", "n").collect()}
        for slot in range(p.total):
            own = [g[7] for g in got if g[4] == slot]
            assert not own and slot not in sums or sums[slot]["sum(n)"] == len(own) and abs(sums[slot]["sum(s)"] - sum(own)) < 1e-9 and abs(sums[slot]["sum(q)"] - sum(v * v for v in own)) < 1e-9


def test_tumbling_drops_remainders(spark):
    df = spark.createDataFrame([("c", 0, 25, "+", 0), ("c", 5, 9, "+", 1)], GENES)
    got = sorted((r["left_start"], r["right_start"]) for r in profile.tumbling_bins(df, 10).collect())
    assert got == [(0, 15), (10, 5)]


def test_pchip_is_monotone_and_meets_knots(spark):
    rng = random.Random(5)
    xs = sorted(rng.sample(range(10, 5_000), 30))
    ys = list(np.cumsum([rng.choice([0, 0, 1, 3.5]) for _ in xs]))
    markers = spark.createDataFrame([("c", x, float(y) + 4) for x, y in zip(xs, ys, strict=True)], "chrom string, bp long, cm double")
    lengths = spark.createDataFrame([("c", 6_000)], "chrom string, length long")
    knots = genmap.anchored(markers, lengths)
    pts = spark.createDataFrame([("c", x) for x in range(0, 6_001, 1)], "chrom string, bp long")
    got = {r["bp"]: r["cm"] for r in genmap.interpolate(pts, knots, size=5, width=512).collect()}
    assert len(got) == 6_001
    at = [got[x] for x in range(6_001)]
    assert all(b - a > -1e-9 for a, b in zip(at, at[1:], strict=False))
    for x, y in zip(xs, ys, strict=True):
        assert abs(got[x] - (y - ys[0])) < 1e-9
    assert got[0] == 0 and abs(got[6_000] - (ys[-1] - ys[0])) < 1e-9


def slopes(xs, ys):
    """The method's slopes, one knot after the other."""
    h = [b - a for a, b in zip(xs, xs[1:])]
    d = [(b - a) / w for a, b, w in zip(ys, ys[1:], h)]
    if len(xs) == 2:
        return [d[0], d[0]]

    def end(h0, d0, h1, d1):
        m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0.0 if np.sign(m) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(m) > 3 * abs(d0) else m

    inner = [0.0 if a * b <= 0 else 3 * (v + w) / ((2 * w + v) / a + (w + 2 * v) / b) for a, b, v, w in zip(d, d[1:], h, h[1:])]
    return [end(h[0], d[0], h[1], d[1]), *inner, end(h[-1], d[-1], h[-2], d[-2])]


def test_pieces_over_seams(spark):
    rng = random.Random(6)
    maps = {c: sorted((x, rng.random() * 9) for x in rng.sample(range(10_000), n)) for c, n in (("two", 2), ("three", 3), ("four", 4), ("five", 5), ("eight", 8), ("many", 41))}
    knots = spark.createDataFrame([(c, x, y) for c, m in maps.items() for x, y in m], "chrom string, bp long, cm double")
    got = {(r["chrom"], r["w_start"]): (r["w_end"], r["y0"], r["y1"], r["d0"], r["d1"], r["last"]) for r in genmap.pieces(knots, size=4, width=900).collect()}
    assert len(got) == sum(len(m) - 1 for m in maps.values())
    for c, m in maps.items():
        xs, ys = zip(*m, strict=True)
        d = slopes(xs, ys)
        for i in range(len(m) - 1):
            w_end, y0, y1, d0, d1, last = got[c, xs[i]]
            assert (w_end, y0, y1, last) == (xs[i + 1], ys[i], ys[i + 1], i == len(m) - 2)
            assert abs(d0 - d[i]) < 1e-12 and abs(d1 - d[i + 1]) < 1e-12


def test_corrections_reverse_blocks(spark):
    m = spark.createDataFrame([("c", i, f"M{i}", float(i)) for i in range(6)], "chrom string, bp long, marker string, cm double")
    blocks = spark.createDataFrame([("c", "M1", 1), ("c", "M2", 1), ("c", "M3", 2), ("c", "M4", 2), ("c", "M5", 2)], "chrom string, marker string, block int")
    got = {r["marker"]: r["cm"] for r in genmap.correct_blocks(m, blocks).collect()}
    assert got == {"M0": 0.0, "M1": 2.0, "M2": 1.0, "M3": 5.0, "M4": 4.0, "M5": 3.0}


def test_lift(spark):
    blocks = spark.createDataFrame([("a", 0, 10, "x", 100, "+"), ("a", 20, 30, "y", 50, "-"), ("a", 25, 26, "z", 7, "+")], "chrom string, w_start long, w_end long, t_chrom string, t_start long, t_strand string")
    pts = spark.createDataFrame([("p", "a", 3, 4), ("q", "a", 15, 16), ("r", "a", 25, 26)], "id string, chrom string, start long, end long")
    got = sorted((r["id"], r["chrom"], r["start"], r["end"]) for r in liftover.lift_points(pts, blocks).collect())
    assert got == [("p", "x", 103, 104), ("r", "y", 54, 55), ("r", "z", 7, 8)]


def test_blocks_at_points(spark):
    """Blocks alone, touching, nested, crossing, equal and much longer than the stretches, against every pair."""
    rng = random.Random(11)
    spans = [(a, a + rng.choice((1, 2, 7, 64, 500))) for a in rng.sample(range(0, 60_000), 150)] + [(61_000, 90_000), (61_500, 61_501), (70_000, 70_064), (70_000, 70_064), (90_000, 90_010), (95_000, 95_000)]
    blocks = spark.createDataFrame([(c, a, b, i) for c in "ab" for i, (a, b) in enumerate(spans)], "chrom string, w_start long, w_end long, n long")
    places = sorted({x + d for a, b in spans for x in (a, b) for d in (-1, 0) if x + d >= 0} | set(rng.sample(range(100_000), 500)))
    points = spark.createDataFrame([("abz"[i % 3], x, f"p{i}") for i, x in enumerate(places)], "chrom string, at long, event string")
    got = sorted((r["event"], r["n"]) for r in asof.blocks_at(points.withColumnRenamed("at", "start"), blocks, "start", width=1000).select("point.event", "block.n").collect())
    assert got == sorted((f"p{i}", n) for i, x in enumerate(places) if "abz"[i % 3] != "z" for n, (a, b) in enumerate(spans) if a <= x < b)


def test_simulated_regions(spark):
    genes = spark.createDataFrame([("chr1", 20_000 * i + 100, 20_000 * i + 15_000, "+-."[i % 3]) for i in range(20)], "chrom string, start long, end long, strand string")
    chroms = spark.createDataFrame([("chr1", 420_000), ("chr2", 90_000)], "chrom string, length long")
    iv = spark.createDataFrame([("chr1", 0, n) for n in (10, 500, 500, 9_000)], "chrom string, start long, end long")
    p = SimulationParams(regions=300)
    rows = sampling.simulate(genes, chroms, iv, p).collect()
    assert rows and len(rows) == 1200
    size = {"chr1": 420_000, "chr2": 90_000}
    spans = {}
    for r in rows:
        assert 0 <= r["start"] < r["end"] <= size[r["chrom"]]
        spans.setdefault(r["ident"].rsplit("_", 1)[1], set()).add(r["end"] - r["start"])
    assert all(len(s) == 1 and s <= {10, 500, 9_000} for s in spans.values())
    parts = sampling.gene_partitions(genes, chroms).filter("class = 'body'").collect()
    own = [(x["chrom"], x["start"], x["end"]) for x in parts]
    for r in rows:
        if r["set"] == "body":
            assert any(c == r["chrom"] and a < r["end"] and r["start"] < z for c, a, z in own)
    again = sampling.simulate(genes.repartition(7), chroms, iv.repartition(3), p).collect()
    assert sorted(rows) == sorted(again)


def test_points_and_lengths_in_stretches(spark):
    """Running totals do not depend on the width of the stretches; each point lies where its pick falls."""
    parts = [(k, f"chr{c}", 700 * i + 10 * c, 700 * i + 10 * c + 5 + i) for k in ("body", "five_prime") for c in (1, 2, 10) for i in range(12)] + [("three_prime", "chr1", 5, 5)]
    annotation = spark.createDataFrame(parts, "class string, chrom string, start long, end long")
    idx = spark.range(1, 400).withColumnRenamed("id", "idx")
    got = sorted(sampling.points(idx, annotation, width=1000).collect())
    assert got == sorted(sampling.points(idx, annotation).collect()) and len(got) == 2 * 399
    for r in got:
        bases = [(c, x) for k, c, a, z in sorted(parts, key=lambda p: p[1:]) if k == r["class"] for x in range(a, z)]
        pick = int(hashlib.md5(f"{r['idx']}|{r['class']}|1|25".encode()).hexdigest()[:14], 16) % len(bases)
        assert (r["chrom"], r["point"]) == bases[pick]
    assert sampling.points(idx, annotation.filter("class = 'three_prime'")).count() == 0
    rows = spark.createDataFrame([(0, n) for n in (3, 3, 9, 40, 2000, 0)], "start long, end long")
    assert sorted(map(tuple, sampling.length_distribution(rows, width=8).collect())) == [(3, 0, 2), (9, 2, 3), (40, 3, 4), (2000, 4, 5)]


def test_stretches_are_shuffled_once(spark):
    """Join and window of a stretch share one partitioning; rows of a null key keep theirs."""
    from pyspark.sql import functions as F

    from chiasma.operators.ordered import stretched, within

    rows = spark.createDataFrame([(None if i % 3 == 0 else "ab"[i % 2], 7 * i % 100) for i in range(100)], "k string, x long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = stretched(rows, ["k"], F.col("x"), {"before": ("sum", F.lit(1))}, 10)
        got = got.withColumn("n", F.col("before") + F.row_number().over(within(["k"], "x")))
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = sorted((r["k"] or "", r["x"], r["n"]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want, seen = [], {}
    for k, x in sorted((r["k"] or "", r["x"]) for r in rows.collect()):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, x, seen[k]))
    assert found == want
    # rows for the join, and the small table's sums, running values and join
    assert plan.count("Exchange hashpartitioning") == 4, plan


def test_annotated_ends_in_other_pieces(spark):
    """Intervals over several pieces, past the knots, backwards, twice, and with a null end."""
    from chiasma.operators import genmap

    knots = spark.createDataFrame([("1", b, c) for b, c in ((0, 0.0), (10, 1.0), (20, 5.0), (30, 5.5), (40, 9.0))], "chrom string, bp long, cm double")
    ends = [(2, 5), (2, 25), (35, 60), (50, 60), (25, 3), (2, 5), (0, 40), (None, 7), (7, None), (60, 4)]
    iv = spark.createDataFrame([("1", a, b, "s", "m") for a, b in ends], "chrom string, start long, end long, sample string, marker string")
    points = spark.createDataFrame([("1", p) for p in range(70)], "chrom string, bp long")
    cm = {r["bp"]: r["cm"] for r in genmap.interpolate(points, knots).collect()}
    got = {(r["start"], r["end"]): (r["start_cM"], r["end_cM"]) for r in genmap.annotate(iv, knots).collect()}
    assert got == {(a, b): (cm.get(a), cm.get(b)) for a, b in set(ends) if a in cm or b in cm}
