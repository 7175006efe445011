"""Near duplicates, mixing, chat and neighbours against brute force."""

import random
import re
from collections import defaultdict

import numpy as np

from chiasma.llm import chat, mixing, near_dup, vectors


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_equals_the_table():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint64)
        b = np.array([x if rng.random() < 0.93 else rng.integers(0, 40) for x in a if rng.random() < 0.97] or [1], np.uint64)
        m = lcs(a.tolist(), b.tolist())
        want = m / (len(a) + len(b) - m)
        got = near_dup.similarity(a, b)
        assert abs(got - want) < 1e-12 if want >= 0.8 else got == 0


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def families(rng):
    """Groups of texts, each made from the one before or the first by changing a few words."""
    rows, i = [], 0
    for size in (1, 1, 2, 4, 12):
        base = words(rng, 150)
        for k in range(size):
            own = list(base)
            for _ in range(2 if k else 0):
                own[rng.randrange(150)] = words(rng, 1)[0]
            if k % 4 == 3:
                base = own  # a chain: the end may be far from the beginning
            rows.append((i, " ".join(own), "en", "s"))
            i += 1
    # a dense family: edits around the threshold, ends cut off, some edits in common
    base, shared = words(rng, 140), words(rng, 9)
    for _ in range(45):
        own = list(base)
        for _ in range(rng.randrange(0, 7)):
            own[rng.randrange(140)] = words(rng, 1)[0]
        if rng.random() < 0.4:
            at = rng.randrange(100)
            own[at : at + 9] = shared
        if rng.random() < 0.4:
            own = own[: -rng.randrange(1, 35)]
        rows.append((i, " ".join(own), "en", "s"))
        i += 1
    return rows


def brute(rows):
    """Classes by all pairs."""
    texts = {}
    for i, t, _, _ in rows:
        if i is not None:
            texts.setdefault(t or "", []).append(i)
    keys = list(texts)
    w, starts = near_dup.words(keys)
    seq = [w[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(keys)):
        for y in range(x):
            if seq[x] and seq[y] and min(len(seq[x]), len(seq[y])) >= 0.8 * max(len(seq[x]), len(seq[y])) and set(seq[x]) & set(seq[y]):
                m = lcs(seq[x], seq[y])
                if m >= 0.8 * (len(seq[x]) + len(seq[y]) - m):
                    root[find(x)] = find(y)
    least = defaultdict(lambda: 1 << 60)
    for k, t in enumerate(keys):
        least[find(k)] = min(least[find(k)], *texts[t])
    return {i: least[find(k)] for k, t in enumerate(keys) for i in texts[t]}


def test_near_dup_classes(make):
    rng = random.Random(9)
    rows = families(rng)
    rows += [(100 + i, rows[3][1], "en", "s") for i in range(5)] + [(200, rows[0][1].upper() + " !", "en", "s"), (201, "two words", "en", "s"), (202, "Two  words.", "en", "s"), (203, "two other", "en", "s"), (204, "!!", "en", "s"), (205, "??", "en", "s"), (206, "", "en", "s"), (207, None, "en", "s")]
    df = make(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_dup_classes(df).collect()}
    assert got == brute(rows)
    kept = near_dup.keep_one(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(got.values()))


def test_near_dup_odd(odd, make, odd_rows):
    got = near_dup.near_dup_classes(odd).collect()
    assert len(got) == len(odd_rows)
    cls = {r["doc_id"]: r["class_id"] for r in got}
    assert cls[5] == cls[6] == 5 and cls[1] == cls[2] == 1 and cls[None] is None
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7]
    assert near_dup.near_dup_classes(make([])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["id"]: r["root"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_all_pairs_of_a_key_are_compared(make, monkeypatch):
    """Pairs of similar texts, each unlike all others, that share one key: no centre links them."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    rows = []
    for i in range(0, 80, 2):
        own = words(rng, 60)
        rows += [(i, " ".join(own), "en", "s"), (i + 1, " ".join([*own[:30], "edited", *own[31:]]), "en", "s")]
    sketches = near_dup.sketches
    monkeypatch.setattr(near_dup, "sketches", lambda docs: sketches(docs).withColumn("band_keys", F.array(F.lit(1).cast("long"))))
    monkeypatch.setattr(near_dup, "BLOCK", 16, raising=False)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_dup_classes(make(rows)).collect()}
    assert got == {i: i - i % 2 for i in range(80)} == brute(rows)


def test_the_bound_rules_out_no_passing_pair():
    rng = np.random.default_rng(4)
    cells = lambda w: np.bincount((near_dup.mixed(w) % np.uint64(near_dup.COUNTS)).astype(np.int64), minlength=near_dup.COUNTS).clip(0, 0xFFFF).astype(np.uint16)
    met = 0
    for _ in range(300):
        a = rng.integers(0, 80, rng.integers(1, 90)).astype(np.uint64)
        b = np.array([x if rng.random() < 0.93 else rng.integers(0, 80) for x in a if rng.random() < 0.96] or [1], np.uint64)
        passes = near_dup.similarity(a, b) > 0
        met += passes
        assert near_dup.may_pass(np.array([len(b)]), cells(b)[None], len(a), cells(a), 0.8)[0] or not passes
    assert met > 100
    long = np.concatenate([np.zeros(70_000, np.uint64), np.arange(100, dtype=np.uint64)])
    assert near_dup.may_pass(np.array([len(long)]), cells(long)[None], len(long), cells(long), 0.8)[0]


def test_near_dup_lists_no_pairs_of_a_hot_key(make, monkeypatch):
    """Of 120 texts of the same words in other orders, and one key, no table has more than a few rows a text; a family of
    two among them, neither of them the centre, is still found."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.permutation(base)) for _ in range(118)]
    texts += [texts[0] + " more", texts[1] + " more"]
    sketches, stored, made = near_dup.sketches, near_dup.stored, {}
    monkeypatch.setattr(near_dup, "sketches", lambda docs: sketches(docs).withColumn("band_keys", F.array(F.lit(1).cast("long"))))
    monkeypatch.setattr(near_dup, "BLOCK", 32)

    def counted(df, name):
        out = stored(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "stored", counted)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_dup_classes(make(rows)).collect()}
    assert got == {i: {118: 0, 119: 1}.get(i, i) for i in range(120)}
    assert max(made.values()) <= 2 * len(texts), made


def test_keys_depend_on_the_text_alone():
    rng = random.Random(5)
    texts = [" ".join(words(rng, n)) for n in (1, 4, 5, 6, 300)] + ["", "x y z " * 40]
    together = [k.tolist() for k in near_dup.keys(*near_dup.shingles(*near_dup.words(texts)))]
    assert together == [near_dup.keys(*near_dup.shingles(*near_dup.words([t])))[0].tolist() for t in texts] and together[5] == []


def targets(sizes):
    """source -> target by sharing again and again."""
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    free, left, out = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}, 1.5 * sum(sizes.values()), {}
    while free:
        level = left / sum(free.values())
        over = [n for n in free if level * free[n] > 2 * sizes[n]]
        if not over:
            return out | {n: level * w for n, w in free.items()}
        for n in over:
            out[n] = 2 * sizes[n]
            left -= out[n]
            del free[n]
    return out


def test_mixing(make, spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 3, 10, 40]))), "en", rng.choice(["a", "b", "c", "B", "é", None, *["a"] * 6])) for i in range(1500)]
    rows += [(7, "x y z", "en", "a")] * 40 + [(None, "n o", "en", "a"), (5000, None, "en", "d")]
    df = make(rows)
    got = mixing.digest(mixing.decide(df)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    of = {i: s for i, _, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[of[r["doc_id"]]] and abs(r["target"] - want[of[r["doc_id"]]]) < 1e-6
        taken[of[r["doc_id"]]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    again = mixing.digest(mixing.decide(df.repartition(7))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    words_out = mixing.mix(df)
    assert words_out.columns == df.columns
    out = defaultdict(int)
    for r in words_out.collect():
        out[r["source"]] += len((r["text"] or "").split())
    assert dict(out) == {s: taken[s] for s in out}


def test_mixing_many_equal_rows(make):
    """Rows without id and rows that repeat: each is decided, and no pair of them is met."""
    rows = [(None, "a b c", "en", "x")] * 5000 + [(None, f"a b {i}", "en", "x") for i in range(3000)] + [(i, "d e", "en", "y") for i in range(500)]
    df = make(rows)
    got = mixing.decide(df).groupBy("source").agg({"copies": "sum", "*": "count"}).collect()
    assert {r["source"]: r["count(1)"] for r in got} == {"x": 8000, "y": 500}
    out = {r["source"]: r["count"] for r in mixing.mix(df).groupBy("source").count().collect()}
    assert out == {r["source"]: r["sum(copies)"] for r in got}


def test_mixing_odd(odd, make):
    got = mixing.decide(odd).collect()
    assert len(got) == odd.count()
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.decide(make([])).count() == 0 and mixing.mix(make([])).count() == 0


CHAT = "conv_id long, turn long, role string, text string, pos int"


def test_chat(spark):
    rng = random.Random(8)
    logs = {}
    for i in range(40):
        full = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for _ in range(rng.randrange(1, 6))]
        logs[2 * i] = full
        logs[2 * i + 1] = full[: rng.randrange(1, len(full) + 1)]
    rows = [(c, t, r, x, 0) for c, turns in logs.items() for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    got = {r["conv_id"]: r for r in chat.chat_format(spark.createDataFrame(rows, CHAT)).collect()}
    want = {}
    for c, turns in logs.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in logs.values())
        first = min(k for k, o in logs.items() if o == turns) == c
        if not longer and first:
            want[c] = "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in turns)
    assert {c: r["rendered"] for c, r in got.items()} == want
    for c, r in got.items():
        assert r["n_turns"] == len(logs[c]) and r["n_copies"] == sum(o == logs[c] for o in logs.values())


def test_chat_odd(spark):
    rows = [(None, 0, "user", "x", 1), (1, None, "user", "late", 1), (1, 0, "user", "b", 1), (1, 0, "user", "b", 1), (2, 0, "user", "x" * 300_000, 1)]
    got = {r["conv_id"]: r["n_turns"] for r in chat.chat_format(spark.createDataFrame(rows, CHAT)).collect()}
    assert got == {None: 1, 1: 3, 2: 1}
    # ties, nulls and a conversation without id of several turns: as SQL has them
    import duckdb

    rows = [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, 1, "assistant", None), (3, 0, "user", "x"), (3, 1, "assistant", None), (4, 1, None, "t"), (4, 1, "user", None), (4, None, "user", "b"), (4, None, "user", "b"), (5, None, "user", "b")]
    shown = chat.chat_format(spark.createDataFrame([(*r, 0) for r in rows], CHAT)).select("conv_id", "n_turns", "n_copies", "rendered").collect()
    c = duckdb.connect()
    c.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(map(str, map(tuple, shown))) == sorted(map(str, c.sql(f"select conv_id, n_turns, n_copies, rendered from ({chat.ORACLE})").fetchall()))
    assert chat.chat_format(spark.createDataFrame([], CHAT)).count() == 0


def test_tile_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = (vectors.Block(np.arange(n), rng.normal(size=(n, 33)) * rng.lognormal(0, 3, (n, 1))) for n in (40, 70))
    near, off = vectors.tile(a, b)
    true = (a.v @ b.v.T) / (a.norm[:, None] * b.norm[None])
    assert (np.abs(true - near) <= off).all() and off.max() < 0.05


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = {i: rng.normal(size=16) for i in range(400)}
    for i in (20, 60, 61, 62, 63, 64, 65, 66, 100):
        v[i] = v[100]
    v[150] = v[3] * 1e-200
    rows = [(i, [float(c) for c in x], 0) for i, x in v.items()]
    bad = [(500, None, 0), (550, [0.0] * 16, 0), (501, [float("nan")] * 16, 0), (502, [float("inf")] + [1.0] * 15, 0), (503, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0), (600, [1.0, 2.0], 0), (601, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in vectors.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {0, 50, 100, 150, 200, 250, 300, 350, 600} and [x[0] for x in got[600]] == [601]
    unit = {i: x / np.abs(x).max() for i, x in v.items()}
    unit = {i: x / np.sqrt((x * x).sum()) for i, x in unit.items()}
    for q in range(0, 400, 50):
        want = sorted((-float(unit[q] @ unit[i]), i) for i in unit if i != q)[:5]
        assert all(abs(s + w) < 1e-12 for (_, s), (w, _) in zip(got[q], want, strict=True))
    assert [x[0] for x in got[100]] == [20, 60, 61, 62, 63]
    # ids that repeat: each row is a candidate, the smallest vector of an id asks
    twice = spark.createDataFrame([(50, [1.0, 0.0], 0), (50, [0.0, 1.0], 0), (1, [1.0, 0.1], 0), (1, [0.0, 2.0], 0), (2, [1.0, 1.0], 0)], "vec_id long, embedding array<double>, rank int")
    assert [(r["vec_id"], round(r["score"], 6)) for r in vectors.nearest(twice).orderBy("rank").collect()] == [(1, 1.0), (2, 0.707107), (1, 0.099504)]
    assert vectors.nearest(df.filter("vec_id < 0")).count() == 0


def test_texts_that_share_an_id(make):
    """Neither text goes because of the other's id; repeated rows and copies under other ids do."""
    a, b = "one text of more than five words here", "another that is wholly unlike the first of them"
    docs = make([(1, a, "en", "s"), (1, b, "en", "s"), (2, a, "en", "s"), (1, a, "en", "s"), (3, b, "de", "t")])
    docs = docs.selectExpr("*", "1 _kept", "2 _kept_key", "'x' _kept_id", "3 _text_key", "4 root")
    kept = near_dup.keep_one(docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, a), (1, b)]) and kept[0]["_text_key"] == 3
