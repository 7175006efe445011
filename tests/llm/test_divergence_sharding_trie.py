"""The divergence audit, the shards and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chiasma.llm import divergence, prefix_trie, sharding


def brute_audit(rows, min_docs):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        counts[lang, source].update(terms(text))
        docs[lang].update(set(terms(text)))
    out = set()
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def p(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        gap = lambda a, b: (a - b) ** 2 // (a + b)
        dist = {s: p(counts[lang, s]) for s in own}
        whole = p(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(sum(gap(dist[s][t], dist[o][t]) for t in kept), o) for o in own if o != s]
            found = [(gap(dist[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and dist[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", found, 10)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def test_divergence(make, odd_rows):
    rng = random.Random(1)
    words = ["Ab", "ab", "Éa", "éa", "x1y", "z", "ß", "\U0001f600q", "İi"] + [f"{a}{b}" for a in "klmn" for b in "opqr"]
    rows = [(i, rng.choice([None, ""]) if i % 17 == 0 else " -\t".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "B"])) for i in range(150)]
    rows += odd_rows + [(500, "only here", "xx", "a"), (501, None, "xx", "b"), (502, "a", "xx", "b")]
    got = {tuple(r) for r in divergence.audit(make(rows).withColumns({"term": F.lit(1), "count": F.lit("c"), "salt": F.lit(0)})).collect()}
    assert got == brute_audit([r[1:] for r in rows], divergence.MIN_DOCS)
    assert divergence.audit(make([])).count() == 0


def test_shares_pass_nine_trillion(spark):
    rows = spark.createDataFrame([(3 * 10**18, 4 * 10**18, 7)], "c long, n long, v long")
    assert rows.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (3 * 10**18 + 2) // (4 * 10**18 + 14)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 41, 1000])
def test_permutation_and_its_inverse(spark, n):
    rows = sharding.permuted(spark.range(n).withColumn("n", F.lit(n).cast("long")), "id", "n", "image")
    rows = sharding.permuted(rows, "image", "n", "back", back=True).collect()
    assert sorted(r["image"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_shards(spark, make, odd_rows, corpus):
    rows = odd_rows + [(None, "no id", "en", None)] * 300 + [(9, "one id", "en", "s"), (9, "two texts", "en", "s")]
    docs = make(rows).withColumns({"shard": F.lit("mine"), "slot": F.lit(1), "_key0": F.lit(2), "n_rows": F.lit(3)})
    got = sharding.digest(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    by = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert [r["doc_id"] is None for r in sorted(got, key=lambda r: r["row_number"])] == sorted((r["doc_id"] is None for r in got), reverse=True)
    assert sorted(sharding.digest(corpus).collect()) == sorted(sharding.digest(corpus.repartition(7)).collect())  # whatever the partitioning
    back = sharding.number_of(sharding.assign(corpus).select("shard", "slot", "n_rows", F.col("row_number").alias("was"))).collect()
    assert all(r["was"] == r["row_number"] for r in back)
    assert sharding.digest(make([])).count() == 0


def test_shard_files(spark, corpus, tmp_path):
    sharding.write_shards(corpus, str(tmp_path / "out"), shards=7)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(rows.select("doc_id", "text").collect()) == sorted(corpus.select("doc_id", "text").collect())
    one = [r["slot"] for r in spark.read.parquet(str(tmp_path / "out/shard=3")).collect()]
    assert one == list(range(len(one)))


def brute_trie(rows):
    """Nodes by path."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def test_trie(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["u", None, ""]), rng.choice(["a", "bb", "", None, "é\U0001f600"])) for c in range(0, 1500, 3) for t in range(rng.randrange(1, 7))]
    rows += [(c, t, "u", "the same") for c in range(2001, 2400) for t in (None, 1, 2)]  # one conversation, often
    rows += [(5000, t, "u", "long " * 2000) for t in range(500)] + [(5001, 0, "u", None), (None, 0, "u", "nobody"), (7100, 0, "u", "base"), (7101, 3, "x", "y"), (7102, None, None, None)]
    rows += [(9000, 1, "u", "twice")] * 2
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"path": F.lit(1), "own": F.lit("x"), "kind": F.lit(2), "base": F.lit(0)})
    assert Counter(tuple(r) for r in prefix_trie.prefix_trie(table).collect()) == brute_trie(rows)
    assert prefix_trie.prefix_trie(table.limit(0)).count() == 0
    alone = prefix_trie.prefix_trie(table.filter("conv_id = 7102")).collect()  # turnless or not by its hash
    assert Counter(tuple(r) for r in alone) == brute_trie([r for r in rows if r[0] == 7102])


def test_merge_of_runs_in_blocks():
    rng = random.Random(3)
    record = lambda i: bytes([i]) * 16 + (i + 1).to_bytes(8, "big")
    paths = sorted({b"".join(record(rng.randrange(3)) for _ in range(rng.randrange(0, 9))) for _ in range(700)})
    rows = [(p, rng.randrange(1, 4), i, "e") for i, p in enumerate(paths)]
    bounds = sorted({paths[i][: 24 * d] for i, d in ((50, 3), (200, 4), (201, 9), (333, 2))} - {b""})
    shuffled = rng.sample(rows, len(rows))
    names = [c.split()[0] for c in prefix_trie.RUN_SCHEMA.split(", ")]
    blocks = [dict(zip(names, b, strict=True)) for k in range(9) for b in prefix_trie.blocks_of(str(k), shuffled[k::9], bounds, 2)]
    out, nodes = [], []
    for at in range(len(bounds) + 1):
        own = sorted((b for b in blocks if b["range"] == at), key=lambda b: (b["forecast"] is not None, b["forecast"] or b"", b["run"]))
        part = list(prefix_trie.merged(iter(own)))
        assert [x[1] for x in part[1:]] == [prefix_trie.common(a[0], b[0]) for a, b in zip(part, part[1:])]
        out += [(p, n, c, e) for p, _, n, c, e in part]
        nodes += prefix_trie.closed(part, bounds[at - 1] if at else b"", bounds[at] if at < len(bounds) else None)
    assert out == rows
    whole = {p[: 24 * d] for p in paths for d in range(len(p) // 24 + 1)}
    inside = [n for n in nodes if n[0] != prefix_trie.PARTIAL]
    assert len(inside) + len({n[10] for n in nodes if n[0] == prefix_trie.PARTIAL}) == len(whole)
    assert len([n for n in nodes if n[0] == prefix_trie.PARTIAL]) <= 2 * 9 * len(bounds) + 5
    assert sum(n[4] for n in nodes if n[2] == 0) == sum(r[1] for r in rows)
