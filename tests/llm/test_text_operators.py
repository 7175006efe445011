"""Personal data, language, fingerprints, licences."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np

from chiasma.llm import fingerprint, language, licences, pii
from chiasma.llm.queries import oracle_sql

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def naive(text):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_are_the_patterns_matches(corpus):
    rng = random.Random(1)
    texts = [r["text"] for r in corpus.collect()] + ["".join(rng.choice("ab1.2@+-() 9%_4") for _ in range(rng.randrange(90))) for _ in range(8000)]
    texts += ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.3.255", "x@a@b.c.d a.b@c.d@e.f", "+1 (555) 010-9999", "9" * 5000, "a" * 5000 + "@"]
    for t in texts:
        assert pii.base_spans(t) == naive(t)


def test_model_finds_base_spans_alone(spark):
    """Real texts, of which none of this fold were trained on: what the patterns find the network finds without them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id is not null and text is not null").collect()
    texts = [r["text"] for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    model = pii.default_model()
    found, hit, wanted = pii.model_spans(texts, model, checked=False), 0, 0
    for text, own in zip(texts, found, strict=True):
        base = pii.base_spans(text)
        wanted += len(base)
        hit += len(set(own) & set(base))
    assert wanted > 10 and hit >= 0.95 * wanted
    held = pii.labelled_examples(300, seed=77)
    found = wanted = wrong = 0
    for (text, spans), own in zip(held, pii.model_spans([t for t, _ in held], model), strict=True):
        got = set(own)
        want = {s for s in spans if s[1] > 0 and s[2] < len(text) and pii.valid(s[0], text[s[1] : s[2]])}
        found, wanted, wrong = found + len(got & want), wanted + len(want), wrong + len(got - set(spans))
    assert found > 0.85 * wanted and wrong < 0.1 * wanted
    local = "Call 555-123-4567 or 030 1234567 today, or write to jo.smith (@) example.org for more."
    assert len(pii.model_spans([local], model)[0]) >= 2
    # what has neither digit nor @, identity numbers, and secrets, all in the spans of the query
    for kind, text, own in ((0, "Please write to karin at example dot com about it.", "karin at example dot com"), (pii.SECRET, 'and passwd="swordfishswordfish" is all', "swordfishswordfish"), (pii.ID, "number 078-05-1120 given", "078-05-1120"), (pii.ID, "pay to DE89 3704 0044 0532 0130 00 now", "DE89 3704 0044 0532 0130 00")):
        a = text.index(own)
        assert (kind, a, a + len(own)) in pii.all_spans([text], model)[0][1]
    for text in ("We look at the window and meet at noon.", "The secret of a password is its length: words.", "Key points follow."):
        assert pii.all_spans([text], model)[0][1] == []
    # few windows of plain text are run
    marked = sum(len(np.unique(model.marked(pii.classes(t)) // pii.STRIDE)) for t in texts)
    assert marked < 0.05 * sum(len(t) / pii.STRIDE for t in texts)


def test_gate_sums_by_brute_force():
    model = pii.default_model()
    for text in ("", "a", "password: abc", "Ünïcode 東京 at dot " * 9):
        c = pii.classes(text)
        w = model.gate[pii.trigrams(c)].astype(float)
        want = [w[max(0, i - pii.SPREAD) : i + pii.SPREAD + 1].sum() for i in range(len(c))]
        assert np.allclose(pii.gate_sums(c, model.gate), want)
        assert c.tolist() == [ord(x) if ord(x) < 128 else 128 if x.isalpha() else 129 if x.isdigit() else 130 for x in text]


def test_one_decoding_of_the_whole_text():
    rng = np.random.default_rng(0)
    t = pii.TAGS
    model = pii.default_model()
    text = " ".join(x for x, _ in pii.labelled_examples(30, seed=78)) + " plain words only " * 60
    # all windows and those that the gate marks give the same spans; so do texts alone and together
    near, every = pii.model_spans([text], model), pii.model_spans([text], model, every=True)
    assert near == every and near[0]
    texts = [text[:500], "none here", text, "9" * 300, text[700:]]
    assert pii.model_spans(texts, model) == [pii.model_spans([x], model)[0] for x in texts]
    # decoding of runs against the plain recursion
    e = rng.normal(0, 2, (900, t)).astype(np.float32)
    starts, ends = np.array([3, 50, 51, 300, 700]), np.array([40, 51, 290, 650, 701])
    tags = model.decode(e, starts, ends)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        best, back = e[a] + model.trans[0], []
        for i in range(a + 1, b):
            paths = best[:, None] + model.trans
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + e[i]
        want = [int((best + model.trans[:, 0]).argmax())]
        for step in back[::-1]:
            want.append(int(step[want[-1]]))
        assert tags[a:b].tolist() == want[::-1]
    assert not tags[650:700].any()


def test_training_learns():
    examples = pii.labelled_examples(200, seed=3)
    assert pii.loaded(pii.saved(pii.train(examples, steps=2, batch=16))).trans.shape == (pii.TAGS, pii.TAGS)
    real = pii.real_examples(["x 10.0.0.1 y"] * 5 + ['token = "abcdefabcdefabcdef12" 1.2.3.4'], most=4)
    plain = pii.plain_examples(["a" * 300 + "@b.cd", "", "1.2.3.4"])
    assert len(plain) == 3 and all(len(t) <= pii.WINDOW for t, _ in plain) and ("1.2.3.4", [(1, 0, 7)]) in plain
    more = pii.train(examples, steps=1, batch=8, start=pii.default_model())
    assert more.trans.shape == (pii.TAGS, pii.TAGS) and np.isfinite(more.out).all()
    assert len(real) == 4 and all(k in (1, pii.SECRET) and text[a:b].strip() == text[a:b] for text, spans in real for k, a, b in spans)


def test_pii_query_and_redaction(corpus, odd, make):
    for df in (corpus, odd, make([])):
        rows = df.collect()
        got = sorted(map(tuple, pii.digest(pii.find(df)).collect()), key=str)
        assert len(got) == len(rows)
        sums = sorted(str((r["doc_id"], hashlib.sha256(pii.shown(naive(r["text"] or "")).encode()).hexdigest())) for r in rows)
        assert sorted(str((g[0], g[5])) for g in got) == sums
        assert all(g[9] == sum(g[1:5]) + g[7] + g[8] and g[6].count(":") == 2 * g[9] for g in got)
        clean = pii.redact(df)
        assert clean.columns == df.columns
        for r in clean.collect():
            assert (r["text"] is None and r["n_chars"] is None) or (not naive(r["text"]) and r["n_chars"] == len(r["text"]))
    assert pii.redacted("a b@c.de f", [(0, 2, 8)]) == "a <EMAIL> f"


def test_counts_are_of_the_base_spans(make):
    """What the network adds is in ``spans`` and ``n_found`` alone."""
    texts = ["Please write to karin at example dot com about it.", "Write to karin at example dot com or to bob@example.org now.", "Call 555-123-4567 or 030 1234567 today, or write to jo.smith (@) example.org for more.", "0" * 5000 + ".1.2.3"]
    got = {r["doc_id"]: r for r in pii.digest(pii.find(make([(i, t, None, None) for i, t in enumerate(texts)]))).collect()}
    for i, text in enumerate(texts):
        base = naive(text) if i < 3 else [(1, 0, 5006)]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(pii.shown(base).encode()).hexdigest()
        assert got[i]["n_found"] == got[i]["spans"].count(":") // 2
    assert all(got[i]["n_found"] > sum(got[i][f"n_{k}"] for k in pii.KINDS) for i in range(3))
    assert pii.valid(1, "0" * 5000 + ".1.2.3") and not pii.valid(1, "256.1.2.3")


def test_language(corpus, odd, make):
    rows = {r["doc_id"]: r for r in corpus.collect()}
    got = language.digest(corpus).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(rows) and held
    assert sum(r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)
    assert not any(r["rejected"] for r in got)
    model = language.train(corpus)
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.digest(corpus.repartition(5)).collect()}
    assert all(again[r["doc_id"]][0] == r["lang_pred"] and abs(again[r["doc_id"]][1] - r["score"]) < 1e-9 for r in got)
    # the nearest centroid again, one text and one n-gram at a time
    for r in got[:40]:
        text = rows[r["doc_id"]]["text"] or ""
        if sum(map(str.isalpha, text)) >= 2 * language.PIECE:
            continue
        c = "".join(x.lower()[0] if x.isalpha() else " " for x in text) + "  "
        grams = Counter()
        for i in range(len(c) - 2):
            p, q, s = map(ord, c[i : i + 3])
            if p != 32 or q != 32:
                grams[(p << 21) | q] += 1
            if q != 32 or (p != 32 and s != 32):
                grams[((((p << 21) | q) << 21) | s | (1 << 63)) % (1 << 64)] += 1
        x = np.zeros(language.FEATURES)
        for code, n in grams.items():
            x[int(language.mixed(np.array([code], np.uint64))[0]) % language.FEATURES] += n
        v = np.log1p(x) * model.idf
        if not v.any():
            assert r["lang_pred"] == language.UND
            continue
        near = [float(v @ m / np.sqrt(v @ v)) for m in model.centroids]
        best = max(range(len(near)), key=near.__getitem__)
        assert abs(max(near) - r["score"]) < 1e-9 and model.languages[model.of[best]] == r["lang_pred"]
    for r in language.digest(odd, model).collect():
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 4)) and 0 <= r["score"] <= 1
    kept = language.identify(odd, model)
    assert kept.count() == odd.count() and {"bucket", "lang_pred"} <= set(kept.columns)
    assert language.digest(make([])).count() == 0
    assert {r["lang_pred"] for r in language.digest(make([(1, "some text", None, "s")])).collect()} == {"und"}


def test_language_rejects_what_is_far(corpus):
    model = language.train(corpus)
    rng = random.Random(2)
    junk = " ".join("".join(rng.choice("xqzjkvwбгд") for _ in range(9)) for _ in range(80))
    assert model.predict([junk])[2][0]


def test_levels_are_exact_and_local():
    rng = np.random.default_rng(3)
    total = np.cumsum(fingerprint._gain())
    for n in (0, 63, 64, 65, 700):
        x = rng.integers(97, 112, n).astype(np.uint8)
        x[n // 3 : n // 2] = 97
        got = fingerprint.levels(x)
        assert len(got) == max(0, n - 63)
        for i, level in enumerate(got):
            t = sum(int(total[c]) for c in np.bincount(x[i : i + 64]) if c)
            assert level == min(1000, max(0, (6 * fingerprint._ONE - t // 64) * 1000 // (6 * fingerprint._ONE)))


def test_fingerprints(corpus, odd, make):
    for df in (corpus, odd, make([(9, "one row", "en", "s")]), make([])):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        counts = fingerprint.level_counts(df)
        whole = [np.bincount(fingerprint.levels(fingerprint.joined_bytes([t])[0]), minlength=1001) for _, t in rows]
        assert (counts == sum(whole, np.zeros(1001, int))).all()
        rank = fingerprint.ranks(counts)
        got = sorted(map(tuple, fingerprint.digest(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        assert [g[0] for g in got] == [r[0] for r in rows]
        for i, (g, (_, text)) in enumerate(zip(got, rows, strict=True)):
            after = rows[(i + 1) % len(rows)][1]
            e = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            f, h, n = (fingerprint.Print.of(fingerprint.features([t], rank)[0]) for t in (text, e, after))
            assert g[1:] == (len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), str(f), str(h), fingerprint.likeness(f, h), fingerprint.likeness(f, n))


def test_features_and_likeness_by_brute_force():
    rng = random.Random(12)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(260))
    other = text[:700] + "".join(rng.choice("klmnopq ") for _ in range(900))
    rank = fingerprint.ranks(np.bincount(fingerprint.levels(fingerprint.joined_bytes([text + other])[0]), minlength=1001))

    def brute(t):
        raw = t.encode()
        windows = [raw[i : i + 64] for i in range(len(raw) - 63)]
        total = np.cumsum(fingerprint._gain())
        level = [min(1000, max(0, (6 * fingerprint._ONE - sum(int(total[n]) for n in Counter(w).values()) // 64) * 1000 // (6 * fingerprint._ONE))) for w in windows]
        votes = Counter()
        for i in range(len(windows) - 63):
            ranked = [(rank[level[j]], j) for j in range(i, i + 64) if rank[level[j]] >= 0]
            if ranked:
                votes[min(ranked)[1]] += 1
        chosen = [windows[j] for j in sorted(votes) if votes[j] >= 16]
        return list(dict.fromkeys(chosen))

    made = {}
    for t in (text, other):
        (got, few), want = fingerprint.features([t], rank)[0], brute(t)
        raw = t.encode()
        short = {int(fingerprint.mixed(np.array([int.from_bytes(raw[i : i + 8], "little")], np.uint64))[0]) for i in range(len(raw) - 7)}
        assert few.tolist() == sorted(short)[:160]
        assert len(got) == len(want) > 5
        hashes = [int(fingerprint.span_hashes(np.frombuffer(w, np.uint8))(np.array([0]), np.array([64]))[0]) for w in want]
        assert hashes == got.tolist()
        filters = [{(h >> (12 * k)) % 2048 for h in hashes[i : i + 160] for k in range(5)} for i in range(0, len(hashes), 160)]
        bits = np.unpackbits(fingerprint.chain(got), axis=1)
        assert [set(np.flatnonzero(row).tolist()) for row in bits] == filters
        made[t] = (fingerprint.chain(got), filters)
    (a, x), (b, y) = made[text], made[other]
    score = lambda p, q: min(1, max(0, (len(p & q) - len(p) * len(q) / 2048) / (min(len(p), len(q)) - len(p) * len(q) / 2048)))
    one = sum(max(score(p, q) for q in y) * len(p) for p in x) / sum(map(len, x))
    two = sum(max(score(p, q) for p in x) * len(q) for q in y) / sum(map(len, y))
    want = one if len(x) < len(y) else two if len(y) < len(x) else (one + two) / 2
    assert abs(fingerprint.overlap(a, b) - want) < 1e-12
    p, q = (fingerprint.Print.of(fingerprint.features([t], rank)[0]) for t in (text, other))
    mean = (p.n[0] + q.n[0]) / 2
    assert abs(fingerprint.likeness(p, q) - (mean * want + 8 * fingerprint.overlap(p.short, q.short)) / (mean + 8)) < 1e-12
    # short texts: likeness falls with the share kept
    short = "".join(rng.choice("abcdefghij ") for _ in range(100))
    other = short[:50] + "".join(rng.choice("klmnopqrst ") for _ in range(50))
    c, d, e = (fingerprint.Print.of(fingerprint.features([t], rank)[0]) for t in (short, other, "".join(rng.choice("uvwxyz ") for _ in range(100))))
    assert 0.25 < fingerprint.likeness(c, d) < 0.75 and fingerprint.likeness(c, e) < 0.1


def test_fingerprint_of_one_changed_character_at_all_lengths():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9)))
    whole = [" ".join(word() for _ in range(400)) for _ in range(60)]
    rank = fingerprint.ranks(np.bincount(fingerprint.levels(fingerprint.joined_bytes(["".join(whole)])[0]), minlength=1001))
    made = lambda texts: [fingerprint.Print.of(f) for f in fingerprint.features(texts, rank)]
    for n in (40, 100, 127, 128, 141, 142, 150, 170, 200, 260, 400, 800, 1600):
        texts = [w[:n] for w in whole]
        places = [rng.randrange(n) for _ in texts]
        near = [fingerprint.likeness(a, b) for a, b in zip(made(texts), made([t[:i] + "#" + t[i + 1 :] for t, i in zip(texts, places, strict=True)]), strict=True)]
        assert min(near) > 0.5 and sum(near) / len(near) > 0.7
        half = [fingerprint.likeness(a, b) for a, b in zip(made(texts), made([t[: n - n // 2] + u[: n // 2] for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]), strict=True)]
        far = [fingerprint.likeness(a, b) for a, b in zip(made(texts), made(texts[1:] + texts[:1]), strict=True)]
        assert min(half) > max(far) + 0.1 and max(far) < 0.2
        print(n, [round(f(xs), 2) for xs in (near, half, far) for f in (min, lambda xs: sum(xs) / len(xs), max)])


def test_fingerprint_likeness_follows_the_edit():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9)))
    a, b = (" ".join(word() for _ in range(1500)) for _ in range(2))
    rank = fingerprint.ranks(np.bincount(fingerprint.levels(fingerprint.joined_bytes([a + b])[0]), minlength=1001))
    made = [fingerprint.Print.of(fingerprint.features([t], rank)[0]) for t in (a, b, a[: len(a) // 2] + b[len(b) // 2 :])]
    assert fingerprint.likeness(made[0], made[0]) == 1 and fingerprint.likeness(made[0], made[1]) < 0.15
    assert 0.3 < fingerprint.likeness(made[0], made[2]) < 0.7
    assert abs(fingerprint.likeness(made[0], made[2]) - fingerprint.likeness(made[2], made[0])) < 1e-12


def test_licences(spark, odd, make):
    s = licences.SENTENCES
    mit = "\n".join([s["mit-grant-only"], "", s["mit-notice"] + ".", s["mit-as-is"] + ".", s["mit-liability"] + "."])
    apache = f"{s['apache-header']}. {s['apache-copy']}\nhttp://x\n{s['apache-basis']}. {s['apache-see']}."
    rows = [(1, mit, "en", "s"), (2, "Hello. " + s["mit-short"] + ". Licensed under the APACHE license,  version 2.0!", "en", "s"), (3, apache, "en", "s"), (4, s["mit-grant"] + ".", "en", "s")]
    got = {r["doc_id"]: (r["n_matches"], r["licences"]) for r in licences.licence_scan(make(rows)).collect()}
    assert got[1] == (1, "MIT:mit-lines:1") and got[2] == (2, "MIT:mit-short:1,Apache-2.0:apache-short:1")
    assert got[3] == (1, "Apache-2.0:apache-header:1")
    assert licences.licence_scan(odd).count() == odd.count() and licences.licence_scan(make([])).count() == 0
    import duckdb

    c = duckdb.connect()
    c.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(c.sql(f"select doc_id, n_matches, licences from ({oracle_sql()['op6_licences']})").fetchall())
    assert sorted(map(tuple, licences.licence_scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect())) == want


def test_language_keeps_long_clean_texts(corpus):
    model = language.train(corpus)
    clean = {}
    for r in sorted(corpus.collect(), key=lambda r: r["doc_id"]):
        clean.setdefault(r["lang"], []).append(r["text"])
    assert len(clean) == 4
    for lang, texts in clean.items():
        once = "\n".join(texts)
        for letters in (30_000, 120_000, 1_000_000):
            text = (once + "\n") * (letters * 5 // 4 // len(once) + 1)
            assert sum(map(str.isalpha, text)) >= letters
            got, _, rejected = model.predict([text])
            assert got == [lang] and not rejected[0]
    # a class of length that no row falls in is as wide as the classes below it
    short = [(lang, t[:700]) for lang, texts in clean.items() for t in texts]
    x, letters = language.profiles([t for _, t in short])
    few = language.fit([lang for lang, _ in short], x, letters, [t for _, t in short])
    assert (few.reach[:, -1] >= few.reach[:, language.length_class(letters).max()]).all()


def test_language_profile_is_the_mean_over_pieces():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(2500))
    letters = [i for i, c in enumerate(text) if c != " "]
    n = len(letters) // language.PIECE
    cuts = [0, *[letters[k * len(letters) // n] for k in range(1, n)], len(text)]
    # a piece's last n-grams reach into the next piece by two characters
    want = np.zeros(language.FEATURES)
    for a, b in zip(cuts, cuts[1:], strict=False):
        x = np.zeros(language.FEATURES)
        padded = text + "  "
        for i in range(a, b):
            p, q, s = padded[i], padded[i + 1], padded[i + 2] if i + 2 < len(padded) else " "
            codes = [(ord(p) << 21) | ord(q)] if p != " " or q != " " else []
            if q != " " or (p != " " and s != " "):
                codes.append(((((ord(p) << 21) | ord(q)) << 21) | ord(s) | (1 << 63)) % (1 << 64))
            for code in codes:
                x[int(language.mixed(np.array([code], np.uint64))[0]) % language.FEATURES] += 1
        want += np.log1p(x) / n
    got, count = language.profiles(["x", text, "", "yy zz"])
    assert count.tolist() == [1, len(letters), 0, 4] and n > 5 and np.allclose(got[1], want)
    assert np.allclose(got[1], language.profiles([text])[0][0]) and not got[2].any()


def test_language_rejects_latin_gibberish_and_a_foreign_language(corpus):
    model = language.train(corpus)
    rng = random.Random(6)
    gibberish = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(60_000))
    polish = (
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem "
        "i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w "
        "niniejszej Deklaracji bez względu na jakiekolwiek różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych "
        "i innych, narodowości, pochodzenia społecznego, majątku, urodzenia lub jakiegokolwiek innego stanu. "
    )
    italian = (
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e "
        "devono agire gli uni verso gli altri in spirito di fratellanza. Ad ogni individuo spettano tutti i diritti e tutte "
        "le libertà enunciate nella presente Dichiarazione, senza distinzione alcuna, per ragioni di razza, di colore, di "
        "sesso, di lingua, di religione, di opinione politica o di altro genere, di origine nazionale o sociale. "
    )
    far = [gibberish[:n] for n in (60, 100, 160, 400, 1000, 4000, 300_000)] + [(polish * 1000)[:n] for n in (60, 100, 160, 400, 1000, 4000, 300_000)]
    far += [(italian * 1000)[:n] for n in (1200, 4000, 300_000)]
    assert model.predict(far)[2].all()
    # the reach of each language at each length is below any distance, and wider for shorter texts
    assert model.reach.shape == (4, language.CLASSES) and (model.reach < 1).all() and (np.diff(model.reach, axis=1) <= 0).all()


def test_licences_wrapped(make):
    import textwrap

    s = licences.SENTENCES
    wrap = lambda t, mark="", first="": "\n".join(mark + line for line in textwrap.wrap(first + t, 70))
    url = "http://www.apache.org/licenses/LICENSE-2.0"
    apache = [s["apache-header"] + ".", s["apache-copy"], url, f"{s['apache-basis']}. {s['apache-see']}."]
    mit = [s["mit-title2"], "Copyright (c) 2020 A B", s["mit-grant-only"], s["mit-notice"] + ".", f"{s['mit-as-is']}. {s['mit-liability']}."]
    gpl = [f"{s['gpl-free']}.", f"{s['gpl-hope']}. {s['gpl-more']}."]
    bsd = [s["bsd-redist"], "1. " + s["bsd-source"] + ".", "2. " + s["bsd-binary"] + ".", "3. " + s["bsd-endorse"] + "."]
    isc = ["Copyright 2020 A B", s["isc-grant"] + "."]
    cases = [(mit, "MIT:mit-lines:1,MIT:mit-title2:1"), (apache, "Apache-2.0:apache-full:1"), (gpl, "GPL-3.0-or-later:gpl3-full:1"), (bsd, "BSD-3-Clause:bsd3-full:1"), (isc, "ISC:isc-grant:1")]
    rows, want = [], {}
    for parts, found in cases:
        for mark in ("", " * ", "# ", "// ", "REM ", "dnl "):
            for gap in ("\n" + mark.rstrip() * (mark.strip().isalpha() is False) + "\n", "\r\n\r\n"):
                rows.append((len(rows), f"/*\n{gap.join(wrap(p, mark) for p in parts)}\n */\nint x = 1;", "en", "s"))
                want[len(rows) - 1] = found
    # the header wrapped before (the "License"), where its first line is a sentence too; no blank line after the copyright
    rows.append((900, 'Copyright 2020 A\nLicensed under the Apache License, Version 2.0\n(the "License"); you may not use this file except\nin compliance with the License. You may obtain a copy of the License at ' + url + "\n\n" + wrap(s["apache-basis"] + ". " + s["apache-see"] + "."), "en", "s"))
    want[900] = "Apache-2.0:apache-full:1"
    # once wrapped, once on one line without an end; words of a sentence with others before or after are none
    rows.append((901, wrap(s["isc-grant"] + ".") + "\nfoo\n" + s["isc-grant"] + "\nbar", "en", "s"))
    want[901] = "ISC:isc-grant:2"
    rows.append((902, "We are not licensed under the\nMIT License here", "en", "s"))
    want[902] = ""
    for text, found in (
        ("// SPDX-License-Identifier: Apache-2.0\nint x;", "Apache-2.0:spdx-apache-2.0:1"),
        ("# SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0:spdx-mit-or-apache-2.0:1"),
        ("Dual licensed under the MIT License or the Apache\nLicense, Version 2.0.", "MIT OR Apache-2.0:dual-mit-apache:1"),
        ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", "MPL-2.0:mpl2-header:1"),
        (wrap(s["lgpl21-free"] + ".", " * "), "LGPL-2.1-or-later:lgpl21-grant:1"),
        (wrap(s["agpl3-free"] + ".", "# "), "AGPL-3.0-or-later:agpl3-grant:1"),
        (wrap(s["epl2-terms"], "// "), "EPL-2.0:epl2-terms:1"),
        ("MIT License\nCopyright 2020 A\nMIT License", "MIT:mit-title2:2"),
        ("version 2.0. Then 2.0 again.", ""),
        ("one word a line\n" * 3000 + "MIT\nLicense\n" + "the\n" * 3000, "MIT:mit-title2:1"),
        ("MIT License " + "word " * 50_000, ""),
    ):
        want[len(rows) + 1000] = found
        rows.append((len(rows) + 1000, text, "en", "s"))
    rows += [(None, None, None, None), (None, "", None, None)]
    docs = make(rows)
    got = {r["doc_id"]: r["licences"] for r in licences.licence_scan(docs).collect()}
    assert got.pop(None) == "" and {k: v for k, v in got.items() if v != want[k]} == {}
    # the SQL finds the same in wrapped texts
    import duckdb

    c = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    c.register("documents", documents)
    sql = c.sql(licences.oracle()).fetchall()
    key = lambda r: (str(r[0]), r[2])
    assert sorted(sql, key=key) == sorted(map(tuple, licences.licence_scan(docs).select("doc_id", "n_matches", "licences").collect()), key=key)


def test_licence_hints_cover_every_sentence():
    words = licences.hints(licences.SENTENCES)
    assert len(words) < 12 and all(set(words) & set(licences.normalised(s).split()) for s in licences.SENTENCES.values())


def test_fingerprint_computes_the_windows_of_edited_texts_once(monkeypatch):
    """Features of edited texts are those of the whole, though only windows over their joints are computed anew."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdeé €\U0001f600\ud800 ") for _ in range(n)) for n in (0, 1, 7, 8, 9, 63, 64, 65, 130, 0, 5000, 128, 3, 900, 20_000, 127)]
    parts = [fingerprint.halves(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    changed = [fingerprint.edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    rank = fingerprint.ranks(np.bincount(fingerprint.levels(fingerprint.joined_bytes(texts)[0]), minlength=1001))
    want, seen, levels = fingerprint.features(texts + changed, rank), [], fingerprint.levels
    monkeypatch.setattr(fingerprint, "levels", lambda x: (seen.append(len(x)), levels(x))[1])
    got = fingerprint.features_of_run(texts, parts, rank)
    assert len(got) == len(want) and all(np.array_equal(a, b) for f, g in zip(got, want, strict=True) for a, b in zip(f, g, strict=True))
    assert any(len(f[0]) for f in got[len(texts) :])
    assert sum(seen) <= len(fingerprint.joined_bytes(texts)[0]) + 126 * len(parts)
