"""Exact, memoised encoding with the ``tokenizers`` library.

Both vocabularies used here split a text into pre-tokens that are encoded independently of each other, so a
pre-token met before need not be encoded again: the library's model is asked for each new one and the document's ids
are the concatenation. The split below is used only for texts made of ASCII and Latin letters, for which it is the
tokenizer's own; every other text goes through the library as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

# Letters and characters for which the split below equals the tokenizers' own.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įıĲ-ňŊ-ž"
_SAFE = re.compile(rf"[ -~\t\n\r×÷{_LETTERS}]*")
_CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"
# letters come first, as most pre-tokens are words and no other alternative begins with a letter
_BYTE_LEVEL = re.compile(rf" ?[{_LETTERS}]+|{_CONTRACTIONS}| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_WORD_LEVEL = re.compile(rf"[{_LETTERS}]+|{_CONTRACTIONS}|[0-9]|[^\s0-9{_LETTERS}]+")

#: Entries of the memo's generations per Python worker, and the longest entry that outlives its batch.
MEMO_ENTRIES = 240_000
MEMO_CHARS = 64
#: Characters and texts handled at once.
BATCH_CHARS = 1_000_000
BATCH_TEXTS = 2_000


def _byte_letters() -> dict[int, int]:
    """Of each byte the code point that stands for it in a byte-level vocabulary: itself if it shows, else 256 upwards."""
    shows = np.zeros(256, bool)
    for a, b in ((33, 126), (161, 172), (174, 255)):
        shows[a : b + 1] = True
    return dict(enumerate(np.where(shows, np.arange(256), 255 + np.cumsum(~shows)).tolist()))


class Memo(dict):
    """What ``of`` makes of each key, in two generations: an entry that is not asked for during a whole one is forgotten."""

    def __init__(self, of: Callable[[str], bytes] | None = None, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.of, self.limit, self._before = of, limit, {}

    def _recalled(self, key: str) -> bytes | None:
        """What the older generation has, moved to the younger."""
        if len(self) > self.limit:
            self._before = dict(self)
            self.clear()
        found = self._before.get(key)
        if found is not None:
            self[key] = found
        return found

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of ``wanted``, none of which is in the younger generation, that are in neither; the others move to it."""
        return [k for k in wanted if self._recalled(k) is None]

    def __missing__(self, key: str) -> bytes:
        found = self._recalled(key)
        if found is None:
            found = self.of(key)
            if len(key) <= MEMO_CHARS:
                self[key] = found
        return found


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        self._split, self._lower = None, False
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]:
            self._split = _BYTE_LEVEL
        elif pre["type"] == "Sequence" and spec["model"].get("end_of_word_suffix"):
            self._split, self._lower = _WORD_LEVEL, True
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        self._model, self._letters = self._tokenizer.model, _byte_letters()
        self._as_bytes = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._memo = Memo(self._pre_token)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def _pre_token(self, word: str) -> bytes:
        """Ids of a pre-token from the library's model, which takes it in the letters of a byte-level vocabulary."""
        letters = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self._letters)
        ids = self._as_bytes
        return b"".join([ids[t.id] for t in self._model.tokenize(letters)])

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        odd, of = [], self._memo.__getitem__
        for i, text in enumerate(texts):
            if self._split is None or not _SAFE.fullmatch(text) or any(s in text for s in self._special):
                odd.append(i)
            else:
                out[i] = b"".join(map(of, self._split.findall(text.lower() if self._lower else text)))
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per vocabulary and Python worker; its memo serves all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def in_batches(texts: Iterable[str | None], limit: int = BATCH_CHARS, most: int = BATCH_TEXTS) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) of runs of at most ``most`` texts and ``limit`` characters; a longer text stands alone."""
    start, run, n = 0, [], 0
    for i, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        if run and (n + len(text) > limit or len(run) >= most):
            yield start, run
            start, run, n = i, [], 0
        run.append(text)
        n += len(text)
    if run:
        yield start, run
