"""Interval operators against sets of positions."""

import random

from pyspark.sql import functions as F

from chiasma.operators import intervals as iv

SCHEMA = "chrom string, start long, end long, class string"


def covered(rows):
    return {(r["chrom"], p) for r in rows for p in range(r["start"], r["end"])}


def random_rows(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randrange(200)
        out.append((rng.choice(["x", "y"]), a, a + rng.randrange(1, 15), rng.choice("abc")))
    return out


def disjoint(rows):
    rows = sorted((r["chrom"], r["start"], r["end"]) for r in rows)
    return all(p[0] != q[0] or p[2] < q[1] for p, q in zip(rows, rows[1:], strict=False))


def test_merge_joins_touching_not_gaps(spark):
    rows = [("x", 0, 5, "a"), ("x", 5, 7, "a"), ("x", 8, 9, "a"), ("x", 1, 2, "a"), ("x", 1, 2, "a")]
    got = iv.merge_intervals(spark.createDataFrame(rows, SCHEMA), width=4).collect()
    assert sorted((r["start"], r["end"]) for r in got) == [(0, 7), (8, 9)]


def test_merge_subtract_exclusive_match_sets(spark):
    for seed in range(3):
        df = spark.createDataFrame(random_rows(seed), SCHEMA)
        rows = df.collect()
        merged = iv.merge_intervals(df, width=16).collect()
        assert covered(merged) == covered(rows) and disjoint(merged)
        got = iv.subtract_intervals(df.filter("class = 'a'"), df.filter("class = 'b'"), width=16).collect()
        of = {c: covered([r for r in rows if r["class"] == c]) for c in "abc"}
        assert covered(got) == of["a"] - of["b"] and disjoint(got)
        only = iv.exclusive_partitions(df, ["a", "b", "c"], width=16).collect()
        for c in "abc":
            others = set().union(*[of[o] for o in "abc" if o != c])
            own = [r for r in only if r["class"] == c]
            assert covered(own) == of[c] - others and disjoint(own)


def test_subtract_nothing(spark):
    df = spark.createDataFrame([("x", 3, 9, "a")], SCHEMA)
    got = iv.subtract_intervals(df, df.filter("start < 0")).collect()
    assert [(r["start"], r["end"]) for r in got] == [(3, 9)]


def test_joins_give_each_pair_once(spark):
    rng = random.Random(4)
    signal = [("x", a := rng.randrange(300), a + rng.randrange(0, 40), float(i)) for i in range(80)]
    wins = [("x", a := rng.randrange(300), a + rng.randrange(1, 60), i) for i in range(40)]
    s = spark.createDataFrame(signal, "chrom string, start long, end long, value double")
    w = spark.createDataFrame(wins, "chrom string, w_start long, w_end long, w int")
    got = sorted((r["w"], r["value"], r["overlap"]) for r in iv.overlapping(s, w, bucket=16).collect())
    want = sorted((k, v, min(e, we) - max(a, ws)) for _, a, e, v in signal for _, ws, we, k in wins if e > a and min(e, we) > max(a, ws))
    assert got == want
    points = s.withColumn("mid", F.shiftright(F.col("start") + F.col("end"), 1))
    got = sorted((r["w"], r["value"]) for r in iv.point_in_window(points, w, "mid", bucket=16).collect())
    assert got == sorted((k, v) for _, a, e, v in signal for _, ws, we, k in wins if ws <= (a + e) // 2 < we)


def test_clip_endpoints_rebuild(spark):
    df = spark.createDataFrame([("x", 0, 5, "s", "i1"), ("x", 8, 9, "s", "i2")], "chrom string, start long, end long, sample string, id string")
    assert [(r["start"], r["end"]) for r in iv.clip(df, 2, 8).collect()] == [(2, 5)]
    ends = iv.endpoints(df)
    assert sorted((r["start"], r["end"]) for r in ends.collect()) == [(0, 1), (4, 5), (8, 9), (8, 9)]
    back = iv.rebuild_intervals(ends)
    assert sorted((r["id"], r["start"], r["end"], r["sample"]) for r in back.collect()) == [("i1", 0, 5, "s"), ("i2", 8, 9, "s")]
    once = iv.rebuild_intervals(ends.filter("start <> 4"))
    assert [r["id"] for r in once.collect()] == ["i2"]


def test_runs_of_a_state_leave_their_changes_alone(spark, monkeypatch):
    """Parts of one class alone, by brute force at several widths; what is stored on the way is not every end."""
    rng = random.Random(21)
    rows = []
    for i in range(600):
        start = rng.randrange(0, 4_000)
        rows.append((rng.choice([None, "a", "b"]), start, start + rng.choice([0, 1, 3, 40, 1_500]), rng.choice("xyz")))
    rows += [("c", 0, 100_000, "x"), ("c", 50, 60, "y"), ("d", 5, 5, "x"), ("d", None, 5, "x")]
    want = set()
    for chrom in (None, "a", "b", "c"):
        last = max(e for c, _, e, _ in rows if c == chrom)
        over = [set() for _ in range(last + 1)]
        for c, s, e, k in rows:
            for i in range(s or 0, e) if c == chrom else ():
                over[i].add(k)
        begin = 0
        for i in range(1, last + 1):
            if over[i] != over[begin] and (len(over[i]) == 1 or len(over[begin]) == 1):
                if len(over[begin]) == 1:
                    want.add((*over[begin], chrom, begin, i))
                begin = i
            elif over[i] != over[begin]:
                begin = i
    table = spark.createDataFrame(rows, SCHEMA)
    kept = []
    monkeypatch.setattr(iv, "stored", lambda df, name, stored=iv.stored: (kept.append(stored(df, name)), kept[-1])[1])
    for width in (16, 1000, 1 << 23):
        kept.clear()
        got = [tuple(r) for r in iv.exclusive_partitions(table, ["x", "y", "z"], width).select("class", "chrom", "start", "end").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert sum(t.count() for t in kept) <= len(want) + 2 * 8  # one stretch a chromosome here: its seams twice
