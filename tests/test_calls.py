"""Cleaning, decoding and calls against plain loops."""

import math
import os
import random

from pyspark.sql import functions as F

from chiasma.operators import genotypes, hmm, marey, switches
from chiasma.params import CleaningParams, HmmParams
from chiasma.plans import adapters

SCHEMA = "map string, input_ord long, chromosome int, coordinate long, snp_name string, genotypes string"


def greedy(xs, gap):
    xs, out, i = sorted(xs), [], 0
    while i < len(xs):
        if i + 1 < len(xs) and xs[i + 1] - xs[i] <= gap:
            i += 2
        else:
            out.append(xs[i])
            i += 1
    return out


def test_collapse_is_greedy(spark):
    rng = random.Random(1)
    rows = [("s%d" % s, c, rng.randrange(0, 60_000_000)) for s in range(20) for c in range(2) for _ in range(rng.randrange(1, 15))]
    rows = list(dict.fromkeys(rows)) + [("edge", 0, 0), ("edge", 0, 1_000_000), ("edge", 0, 2_000_000), ("apart", 0, 0), ("apart", 0, 2_000_000), ("far", 0, 0), ("far", 0, 2_000_001)]
    df = spark.createDataFrame(rows, "sample string, chrom int, bp long")
    got = {}
    for r in hmm.collapse_close_pairs(df, ["sample", "chrom"], "bp", 2_000_000).collect():
        got.setdefault((r["sample"], r["chrom"]), []).append(r["bp"])
    for key in {r[:2] for r in rows}:
        assert sorted(got.get(key, [])) == greedy([r[2] for r in rows if r[:2] == key], 2_000_000)
    assert got[("edge", 0)] == [2_000_000] and ("apart", 0) not in got and len(got[("far", 0)]) == 2


def decode(obs, coords, p=HmmParams()):
    def e(s, o):
        return math.log(p.match if o == "AB"[s] else p.mismatch if o in "AB" else p.missing)

    score, back = [math.log(0.5) + e(s, obs[0]) for s in (0, 1)], []
    for i in range(1, len(obs)):
        t = min(max(1e-8 * max(coords[i] - coords[i - 1], 1), 1e-6), 0.05)
        new, ptr = [], []
        for s in (0, 1):
            c = [score[q] + (math.log(1 - t) if q == s else math.log(t)) for q in (0, 1)]
            k = int(c[1] > c[0])
            new.append(c[k] + e(s, obs[i]))
            ptr.append(k)
        score = new
        back.append(ptr)
    path = [int(score[1] > score[0])]
    for ptr in reversed(back):
        path.append(ptr[path[-1]])
    return "".join(map(str, reversed(path)))


def test_viterbi_matches_loop(spark):
    rng = random.Random(7)
    coords = sorted(rng.sample(range(1, 90_000_000), 40))
    samples = [[("A" if (i // 9 + s) % 2 else "B") if rng.random() < 0.8 else rng.choice("AB-") for i in range(40)] for s in range(8)] + [["-"] * 40]
    rows = [("m", i, 1, c, f"S{i}", "".join(s[i] for s in samples)) for i, c in enumerate(coords)] + [("one", 0, 2, 5, "T", "B-" + "A" * 7)]
    got = {(r["map"], r["dense_idx"]): r["path"] for r in hmm.path_strings(hmm.viterbi(spark.createDataFrame(rows, SCHEMA))).collect()}
    for s, obs in enumerate(samples):
        assert got[("m", s)] == decode(obs, coords)
    assert got[("m", 8)] == "0" * 40 and got[("one", 0)] == "1" and got[("one", 1)] == "0"


def test_viterbi_ties_by_the_c_librarys_logarithms(spark):
    """Two paths of equal probability, told apart by the last bit of the logarithm of one distance."""
    for obs, gaps in (("AA-BA-B", [2, 12, 12, 12, 12, 12]), ("AA-BABA-BB-BB", [1, 12, 1, 1, 12, 1, 12, 12, 2, 1, 1, 1])):
        coords = [240_000 * sum(gaps[:i]) for i in range(len(obs))]
        rows = [("m", i, 1, c, f"S{i:02d}", x) for i, (c, x) in enumerate(zip(coords, obs, strict=True))]
        assert [r["path"] for r in hmm.path_strings(hmm.viterbi(spark.createDataFrame(rows, SCHEMA))).collect()] == [decode(obs, coords)]


def test_viterbi_over_seams(spark):
    """Stretches of a few markers, two blocks of samples, ties, strings that are too short, several markers at one place."""
    rng = random.Random(8)
    coords = sorted(rng.choice(range(0, 30_000_000, 250_000)) for _ in range(95))
    samples = [[("A" if (i // 11 + s) % 2 else "B") if rng.random() < 0.7 else rng.choice("AB---") for i in range(95)] for s in range(70)]
    rows = [("m", i, c % 2, co, f"S{i:03d}", "".join(s[i] for s in samples)[: 66 if i % 10 == 3 else 70]) for c in (1, 2) for i, co in enumerate(coords)]
    paths = hmm.viterbi(spark.createDataFrame(rows, SCHEMA), size=7, width=1 << 20).cache()
    assert paths.selectExpr("max(size(markers))").first()[0] == 7
    got = {(r["chromosome"], r["dense_idx"]): r["path"] for r in hmm.path_strings(paths).collect()}
    want = {s: decode([x if s < 66 or i % 10 != 3 else "-" for i, x in enumerate(samples[s])], coords) for s in range(70)}
    assert got == {(c, s): want[s] for c in (0, 1) for s in range(70)}
    events = {(r["chromosome"], r["dense_idx"], r["left_snp"], r["right_snp"], r["left_state"], r["right_state"]) for r in hmm.state_changes(paths).collect()}
    assert events == {(c, s, f"S{i - 1:03d}", f"S{i:03d}", "AB"[int(p[i - 1])], "AB"[int(p[i])]) for c in (0, 1) for s, p in want.items() for i in range(1, 95) if p[i] != p[i - 1]}


def test_viterbi_of_a_long_chromosome(spark):
    """One chromosome: rows stay of bounded size, and the changes are those of the loop. 5,000,000 markers take three minutes."""
    n = int(os.environ.get("CHIASMA_TEST_MARKERS", "500000"))
    one, two = n * 3 // 25 + 7, n // 4 + 3
    shown = f"case when id % 11 = 0 then '-' when (id * 7919) % 13 = 0 then 'B' when (id div {one}) % 2 = 0 then 'A' else 'B' end"
    other = f"if((id div {two}) % 2 = 0, 'B', 'A')"
    rows = spark.range(n).selectExpr("'m' map", "1 chromosome", "id * 20 coordinate", "string(id) snp_name", f"concat({shown}, {other}) genotypes")
    paths = hmm.viterbi(rows)
    assert paths.selectExpr("max(size(markers))").first()[0] <= 512
    got = sorted((r["dense_idx"], int(r["right_snp"])) for r in hmm.state_changes(paths).select("dense_idx", "right_snp").collect())
    first = decode(["-" if i % 11 == 0 else "B" if i * 7919 % 13 == 0 or i // one % 2 else "A" for i in range(n)], range(0, 20 * n, 20))
    changes = [i for i in range(1, n) if first[i] != first[i - 1]]
    assert len(changes) >= 8
    assert got == sorted([(0, i) for i in changes] + [(1, two * k) for k in (1, 2, 3)])


def test_dedup_ties(spark):
    rows = [("m", 0, 1, 10, "b", "AB-----"), ("m", 1, 1, 10, "c", "AB-----"), ("m", 2, 1, 10, "a", "A------"), ("m", 3, 1, 20, "x", "AAAAAAA"), ("m", 4, 1, 20, "x", "BBBBBBB"), ("m", 5, 1, 30, "p", "AB-"), ("m", 6, 1, 30, "a", "AB")]
    got = {r["coordinate"]: (r["snp_name"], r["genotypes"]) for r in genotypes.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {10: ("c", "AB-----"), 20: ("x", "AAAAAAA"), 30: ("a", "AB")}


def test_flip_rate_crosses_chromosomes(spark):
    rows = [("m", 0, 1, 10, "a", "AAAB"), ("m", 1, 1, 20, "b", "BAA-"), ("m", 2, 2, 5, "c", "ABAB"), ("m", 3, 2, 6, "d", "AAA")]
    got = {r["snp_name"]: r["flip_rate"] for r in genotypes.isolated_flips(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": 0.0, "b": 0.5, "c": 0.5, "d": 0.0}


def test_ragged_and_empty_maps(spark):
    p = CleaningParams()
    rows = [("m", i, 1, 10 * i, f"s{i}", "ABABABAB"[: 8 - (i == 2)]) for i in range(4)] + [("bare", 0, 1, 1, "z", "-------")]
    df = spark.createDataFrame(rows, SCHEMA)
    miss = {(r["map"], r["sample_idx"]): r["missing"] for r in genotypes.sample_missingness(genotypes.deduplicate(df)).collect()}
    assert miss[("m", 7)] == 1 and miss[("m", 0)] == 0 and miss[("bare", 0)] == 1
    clean = genotypes.clean(df, p)
    assert {r["map"] for r in clean.collect()} == {"m"}
    events = hmm.call_events(clean)
    qc = {r["map"]: r for r in genotypes.qc_summary(df, *genotypes.staged(df, p), events).collect()}
    assert qc["bare"]["kept_samples"] == 0 and qc["bare"]["final_markers"] == 0 and qc["bare"]["hmm_events"] == 0
    for r in qc.values():
        assert r["input_markers"] == r["deduplicated_markers"] + r["removed_duplicate_markers"]
        assert r["deduplicated_markers"] == r["removed_markers_missingness"] + r["removed_markers_allele_balance"] + r["removed_markers_isolated_flip"] + r["final_markers"]


def test_required_fields(spark):
    raw = spark.createDataFrame([("m", 0, "1.0", "0", "s", "ABABABA"), ("", 1, "1", "5", "s", "ABABABA"), ("m", 2, "0", "5", "s", "ABABABA"), ("m", 3, "x", "5", "s", "ABABABA"), ("m", 4, "1", None, "s", "ABABABA"), ("m", 5, "1", "5", "s", "ABABAB"), ("m", 6, "1", "5", None, "ABABABA")], "map string, input_ord long, chromosome string, coordinate string, snp_name string, genotypes string")
    assert [r["input_ord"] for r in genotypes.required(raw).collect()] == [0]


def test_switches(spark):
    rows = [("m", i, 1, 1_000_000 * i, f"s{i:02d}", g) for i, g in enumerate(["A", "-", "B", "B", "B", "A", "B", "B", "-", "B"])]
    df = spark.createDataFrame(rows, SCHEMA)
    raw = sorted((r["left_snp"], r["right_snp"], r["event_bp"]) for r in switches.raw_calls(df).collect())
    assert raw == [("s00", "s02", 1_000_000), ("s04", "s05", 4_500_000), ("s05", "s06", 5_500_000)]
    kept = [(r["left_snp"], r["right_snp"]) for r in switches.filtered_calls(df).collect()]
    assert sorted(kept) == [("s00", "s02"), ("s05", "s06")]


def test_runs_over_seams(spark):
    rng = random.Random(9)
    coords = sorted(rng.randrange(0, 40_000_000) for _ in range(60)) + [41_000_000] * 20
    samples = ["".join(rng.choice(("A", "A", "-") if (i // 13 + s) % 2 else ("B", "-", "-", "-")) for i in range(80)) for s in range(67)] + ["-" * 80]
    rows = [("m", i, 1, c, f"S{i:03d}", "".join(s[i] for s in samples)) for i, c in enumerate(coords)]
    got = {(r["sample_idx"], r["run"]): (r["state"], r["n_markers"], r["first_snp"], r["last_snp"], r["span"]) for r in switches.runs(spark.createDataFrame(rows, SCHEMA), size=4, width=1 << 21).collect()}
    want = {}
    for s, g in enumerate(samples):
        seen, k = [(i, x) for i, x in enumerate(g) if x != "-"], 0
        while seen:
            own = []
            while seen and (not own or seen[0][1] == own[0][1]):
                own.append(seen.pop(0))
            k += 1
            want[s, k] = (own[0][1], len(own), f"S{own[0][0]:03d}", f"S{own[-1][0]:03d}", coords[own[-1][0]] - coords[own[0][0]])
    assert got == want


def test_markers_are_computed_once(spark):
    """Runs and cleaning read their input once, whatever it costs."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def noted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([("m", i, 1, 10 * i, f"S{i:02d}", "ABBA-ABAB"[i % 3 :] + "AB") for i in range(40)], SCHEMA)
    rows = rows.withColumn("genotypes", F.udf(noted, "string").asNondeterministic()("genotypes"))
    assert switches.runs(rows).count() and seen.value == 40
    genotypes.clean(rows).collect()
    assert seen.value == 80


def test_marey(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (1, 9_000_000, "a"), (2, 4, "a")], "chromosome int, event_bp long, sample_id string")
    got = sorted((r["chromosome"], r["rank"], r["event_bp"], r["cumulative"]) for r in marey.marey_curve(df, width=8).collect())
    assert got == [(1, 1, 5, 0.5), (1, 2, 9, 1.0), (1, 3, 9_000_000, 1.5), (2, 1, 4, 1.0)]


def test_markers_are_made_by_more_than_the_task_that_reads_their_file(spark):
    rows = adapters.markers(spark, "/root/testdata/sf0.01")
    assert rows.filter("length(genotypes) > 0").select(F.spark_partition_id().alias("task")).distinct().count() > 1
