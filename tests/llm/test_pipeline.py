"""The stages' contracts, their effect on odd and empty tables, and the whole against a plain run."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from chiasma.llm import language, near_dup, pii
from chiasma.llm.queries import tokenizer_file
from tests.llm.test_set_operators import brute, targets

STAGES = dict(corpus_pipeline.STAGES)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages_against_plain_python(spark, corpus):
    rows = corpus.collect()
    seen = {}
    docs = corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == corpus.columns and docs.dtypes == corpus.dtypes
        seen[name] = docs.collect()
    # language: what the model rejects goes, one text at a time
    model = language.train(corpus)
    kept = {r["doc_id"] for r in rows if not model.predict([r["text"] or ""])[2][0]}
    assert {r["doc_id"] for r in seen["language_id"]} == kept and len(kept) > 0.95 * len(rows)
    # near duplicates: all pairs
    own = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in seen["language_id"]]
    classes = brute(own)
    assert sorted(r["doc_id"] for r in seen["near_dedup"]) == sorted(set(classes.values())) and len(set(classes.values())) < len(own)
    # personal data: the spans of each text alone
    text = {r["doc_id"]: r["text"] for r in seen["near_dedup"]}
    net = pii.default_model()
    for r in seen["pii"]:
        (_, every), = pii.all_spans([text[r["doc_id"]]], net)
        assert r["text"] == pii.redacted(text[r["doc_id"]], every) and r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
    # mixing: words of each source near its target, no document more often than twice
    before, after = defaultdict(int), defaultdict(int)
    for r in seen["pii"]:
        before[r["source"]] += size(r["text"])
    for r in seen["mixing"]:
        after[r["source"]] += size(r["text"])
    want, longest = targets(before), max(size(r["text"]) for r in seen["pii"])
    assert all(abs(after[s] - want[s]) <= longest for s in before)
    assert max(Counter(r["doc_id"] for r in seen["mixing"]).values()) <= 2
    # packing: each document's ids once, sequences gapless
    from tokenizers import Tokenizer

    pieces = STAGES["packing"](spark, docs, "").collect()
    copies = Counter(r["doc_id"] for r in seen["mixing"])
    whole = defaultdict(int)
    for p in pieces:
        whole[p["doc_id"]] += p["length"]
    encode = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")).encode
    for r in {r["doc_id"]: r for r in seen["mixing"]}.values():
        assert whole[r["doc_id"]] == copies[r["doc_id"]] * (len(encode(r["text"] or "", add_special_tokens=False).ids) + 1)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_on_odd_and_empty_tables(spark, odd, make):
    for df in (odd, make([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == df.columns and out.dtypes == df.dtypes
            if not df.count():
                assert out.count() == 0
        assert STAGES["packing"](spark, df, "").count() >= df.count()
    left = STAGES["near_dedup"](spark, odd, "").collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 1, 3, 4, 5, 7]
    same = make([(None, "no id but the same words", "en", "s")] * 3 + [(8, "no id but the same words", "en", "s"), (None, "another text without id", "en", "s"), (None, "another text without id", "en", "s")])
    assert sorted(str(r["doc_id"]) for r in near_dup.keep_one(same).collect()) == ["8", "None"]
