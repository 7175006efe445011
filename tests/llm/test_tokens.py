"""Token files and packing: exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chiasma.llm import packing, token_files
from chiasma.llm._encode import Encoder
from chiasma.llm._store import fresh_folder
from chiasma.llm.queries import tokenizer_file

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def plain(name, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer_file(name)).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_equals_the_library(name, corpus, odd_rows):
    enc = Encoder(tokenizer_file(name))
    texts = [r["text"] for r in corpus.collect()] + [t or "" for _, t, _, _ in odd_rows]
    texts += ["<|endoftext|> x", "a  b\n\n c\t\td ", "it's IT'S don't we'll 12345 ''s !'t", "x" * 300, "É É ﬁ", " lead", "trail  ", "a b  c", "ŉ ſ İ ß"]
    got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)]
    assert got == plain(name, texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts[::-1])] == got[::-1]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB '’\n\t1.é-½<|>", max_size=40))
def test_encoder_on_any_text(text):
    for name in (BYTE, WORD):
        enc = test_encoder_on_any_text.__dict__.setdefault(name, Encoder(tokenizer_file(name)))
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == plain(name, [text])[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, unit):
    x = np.array(ids, "<u4")
    assert (token_files.join_planes(token_files.split_planes(x, unit), len(x), unit) == x).all()


def test_file_round_trip_over_blocks():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 50_000, n).astype("<u4").tobytes() for n in (0, 1, 70_000, 5, 65_536)]
    for unit in ("bit", "byte"):
        docs, ids, first = token_files.decode_file(token_files.encode_file([3, None, 5, 5, -1], parts, 17, unit))
        assert (docs, ids, first) == ([3, None, 5, 5, -1], parts, 17)
    with pytest.raises(ValueError):
        token_files.decode_file(b"x" * 40)


def expected(rows, name, end):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for (doc_id, _), ids in zip(rows, plain(name, [t or "" for _, t in rows]), strict=True):
        b = np.array([*ids, end], "<u4")
        out.append((doc_id, at, len(b), zlib.crc32(b.tobytes())))
        at += len(b)
    return out


def test_token_files(spark, corpus, odd, make):
    for df in (corpus, odd, make([])):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        for unit, limit in (("bit", 1 << 21), ("byte", 3000)):
            got = token_files.digest(token_files.token_files(df, tokenizer_file(WORD), fresh_folder(spark, "t"), 2, unit, limit)).collect()
            key = lambda r: (r[0] is not None, r[0] or 0, r[1])
            assert sorted(map(tuple, got), key=key) == expected(rows, WORD, 2)


def test_cuts():
    for n in range(0, 5000):
        parts = packing.cuts(n)
        assert sum(parts) == n and all(0 < p <= 1024 for p in parts) and sum(p not in [1024 // k for k in range(1, 33)] for p in parts) <= 1


def test_packing(corpus, odd, make):
    for df in (corpus, odd, make([])):
        rows = df.collect()
        ids = defaultdict(list)
        for r, e in zip(rows, plain(BYTE, [r["text"] or "" for r in rows]), strict=True):
            ids[r["doc_id"]].append(np.array([*e, 0], "<u4"))
        seqs, cover = defaultdict(list), defaultdict(list)
        for r in packing.digest(packing.pack(df, tokenizer_file(BYTE))).collect():
            assert any(r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for x in ids[r["doc_id"]])
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
            cover[r["doc_id"]].append((r["start"], r["length"]))
        padding = 0
        for parts in seqs.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 1024
            padding += 1024 - at
        for doc_id, own in ids.items():
            assert sum(n for _, n in cover[doc_id]) == sum(len(x) for x in own)
            if len(own) == 1:
                at = 0
                for start, n in sorted(cover[doc_id]):
                    assert start == at
                    at += n
        if rows:
            assert padding <= 1024 * 9 + 0.01 * sum(len(x) for own in ids.values() for x in own)


def test_memo_keeps_the_words_of_a_large_batch():
    """100,000 words after 100,000 others are both still known, so rarer words are not encoded anew each few batches."""
    from chiasma.llm._encode import Memo

    memo = Memo()
    for part in range(2):
        memo.update((f"{part} {i}", b"") for i in memo.missing({str(i) for i in range(100_000)}))
    assert len(memo) == 200_000 and memo.missing({"x"}) == ["x"] and "0 5" in memo


def test_memo_asks_once_and_forgets_within_its_limit():
    """A pre-token is looked up once, as a missing entry is made by the look-up itself; ids stay the library's while it forgets."""
    from chiasma.llm._encode import Encoder, Memo

    asked = []
    memo = Memo(lambda w: asked.append(w) or w.encode(), 3)
    assert b"".join(map(memo.__getitem__, ["a", "b", "a", "x" * 65, "b"])) == b"aba" + b"x" * 65 + b"b"
    assert asked == ["a", "b", "x" * 65] and "x" * 65 not in memo
    enc = Encoder(tokenizer_file("byte_bpe_50k.json"))
    enc._memo = Memo(enc._pre_token, 3)
    texts = ["one two  three\n\n four's 1234 naïve ünï -- " * 3, " tail  ", "", "one"]
    assert enc.encode(texts) == enc._whole(texts) and len(enc._memo) <= 4
