"""Language identification by nearest centroids.

A text's letters, lower-cased and with everything else as spaces, give 2- and 3-grams, hashed into ``FEATURES``
counts. A text of 2 * ``PIECE`` letters or more is cut into equal pieces of ``PIECE`` letters and somewhat more, all
over its length, and the mean of log(1 + count) over the pieces is its profile, so that a profile does not flatten as
a text grows. profile * idf, normalised, is compared by cosine with several centroids per language, found by
spherical k-means on labelled rows.

A text is rejected when its distance from the nearest centroid is beyond the reach of that centroid's language at
the text's length: the ``QUANTILE`` of the distances of labelled rows that a fit on the other labelled rows gives,
loosened to ``ENOUGH`` of the cosine there. For every other class of length below a row's own, the first or the last
letters of its beginning count as a text of that length, so short texts have a reach too. From 2 ** 10 letters on all lengths are one class. A class
with too few distances takes the largest reach of its neighbours or of the other languages; a shorter class is never
stricter than a longer one.

The classifier is fitted on at most ``SAMPLE`` rows per language, spread over all rows by hash; only their profiles
and beginnings reach the driver. Everything else is one scan and one pass: nothing is shuffled. Defined results: null
texts and texts without letters are ``und``, score 0, rejected; rows without id are not learned from; repeated rows
get equal answers; without labelled rows all are ``und``, and with too few to hold any out none with letters is
rejected; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._chars import code_points, joined, letters_lowered, mixed
from ._encode import in_batches
from ._store import small_batches

FEATURES = 4096
CENTROIDS = 4
#: Labelled rows per language that the fit uses at most.
SAMPLE = 400
#: Longer texts are judged by pieces of about as many letters.
PIECE = 1024
#: Share of the held-out labelled distances that a reach covers, and the part of the cosine there that is enough.
QUANTILE, ENOUGH = 0.99, 0.8
#: Distances that a class of length needs, parts of which each is held out once, characters of a row's beginning.
LEAST, PARTS, HEAD = 20, 4, 2048
CLASSES = 11
UND = "und"
_CHARS = 400_000
_PIECES = 256


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean log(1 + count) of hashed 2- and 3-grams over each text's pieces, and its number of letters."""
    raw, starts = joined(texts, 2)
    c = letters_lowered()[raw]
    space = c == 0x20
    before = np.concatenate([[0], np.cumsum(~space)])[starts]
    letters = np.diff(before)
    pieces = np.maximum(letters // PIECE, 1)
    own = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    place = np.append(np.flatnonzero(~space), len(c))
    begin = np.where(nth == 0, starts[own], place[np.minimum(before[own] + nth * letters[own] // pieces[own], len(place) - 1)])
    begin = np.append(begin, len(c))
    inside = np.ones(len(c), bool)
    inside[starts[1:] - 1] = False  # what begins there reaches into the next text
    out = np.zeros((len(texts), FEATURES))
    for first in range(0, len(own), _PIECES):
        of = own[first : first + _PIECES]
        bounds = begin[first : first + len(of) + 1]
        lo, hi = bounds[0], min(bounds[-1], len(c) - 2)
        a, b, d = (c[lo + k : hi + k].astype(np.uint64) for k in range(3))
        sa, sb, sd = (space[lo + k : hi + k] for k in range(3))
        row = np.repeat(np.arange(len(of)), np.diff(np.minimum(bounds, hi)))
        two = (a << np.uint64(21)) | b
        x = np.zeros(len(of) * FEATURES)
        at = inside[lo:hi]
        for code, ok in ((two, at & ~(sa & sb)), ((two << np.uint64(21)) | d | np.uint64(1 << 63), at & ~(sb & (sa | sd)))):
            key = (mixed(code[ok]) % np.uint64(FEATURES)).astype(np.int64) + row[ok] * FEATURES
            x += np.bincount(key, minlength=len(x))
        at = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[at]] += np.add.reduceat(np.log1p(x).reshape(len(of), FEATURES), at, axis=0)
    return out / pieces[:, None], letters


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    of: np.ndarray  # language of each centroid
    reach: np.ndarray  # of each language by class of length

    def vectors(self, x: np.ndarray) -> np.ndarray:
        v = x * self.idf
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine with the nearest centroid, and whether the distance rejects the text."""
        x, letters = profiles(texts)
        cosine = self.vectors(x) @ self.centroids.T if len(self.of) else np.zeros((len(texts), 1))
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        none = (letters == 0) | (len(self.of) == 0)
        score[none] = 0
        lang = [UND if n else self.languages[self.of[b]] for n, b in zip(none, best, strict=True)]
        if len(self.of) == 0:
            return lang, score, none
        return lang, score, none | (1 - score > self.reach[self.of[best], length_class(letters)])


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), CLASSES - 1)


def _clusters(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts; the same for the same rows."""
    chosen = [int((v @ v.sum(axis=0)).argmax())]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    c = v[chosen]
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        c = np.array([v[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-300)
    return c


def _centred(names: list[str], label: np.ndarray, x: np.ndarray, centroids: int) -> Model:
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1 if len(x) else np.ones(FEATURES)
    model = Model(names, idf, np.zeros((0, FEATURES)), np.zeros(0, int), np.full((len(names), CLASSES), 2.0))
    kept = [i for i in range(len(names)) if (label == i).any()]
    if kept:
        own = [_clusters(model.vectors(x[label == i]), centroids) for i in kept]
        model.centroids, model.of = np.concatenate(own), np.repeat(kept, [len(c) for c in own])
    return model


def _cuts(text: str, k: int) -> list[str]:
    """The first or last letters of row k's beginning, as many as every other class of length below its own begins with."""
    place = np.flatnonzero(letters_lowered()[code_points(text)] != 0x20)
    sizes = [1 << c for c in range(k % 2, CLASSES - 1, 2) if 2 << c <= len(place)]
    return [text[: place[n - 1] + 1] if k % 4 < 2 else text[place[-n] :] for n in sizes]


def _reach(model: Model, label: np.ndarray, x: np.ndarray, letters: np.ndarray, heads: list[str], centroids: int) -> np.ndarray:
    """The reach of each language in each class of length, from distances of rows that are held out in turn."""
    far: dict[tuple[int, int], list[float]] = {}
    part = np.zeros(len(label), int)
    for i in range(len(model.languages)):
        part[label == i] = np.arange((label == i).sum()) % PARTS
    for p in range(PARTS):
        fitted = _centred(model.languages, label[part != p], x[part != p], centroids)
        for i in np.unique(label[part == p]):
            near = fitted.centroids[fitted.of == i].T
            if not near.size:
                continue
            held = np.flatnonzero((part == p) & (label == i))
            lots = [(x[held], letters[held])]
            short = [t for k in held for t in _cuts(heads[k], k)]
            lots += [profiles(short[k : k + _PIECES]) for k in range(0, len(short), _PIECES)]
            for own, n in lots:
                for c, d in zip(length_class(n), 1 - (fitted.vectors(own) @ near).max(axis=1), strict=True):
                    far.setdefault((int(i), int(c)), []).append(d)
    reach = np.full((len(model.languages), CLASSES), np.nan)
    for at, d in far.items():
        if len(d) >= LEAST:
            reach[at] = 1 - ENOUGH * (1 - np.quantile(d, QUANTILE))
    if np.isnan(reach).all():
        return np.full(reach.shape, 2.0)
    seen = np.where(np.isnan(reach), -1, reach)
    wide = seen.max(axis=0)  # of all languages
    for c in range(1, CLASSES):
        wide[c] = wide[c] if wide[c] >= 0 else wide[c - 1]  # a longer text lies no farther out than a shorter one
    first = int((wide >= 0).argmax())
    wide[:first] = 2.0  # nothing is known of so short texts
    own = np.maximum.accumulate(seen, axis=1)
    seen = np.where(np.isnan(reach), np.maximum(own, wide), reach)
    return np.maximum.accumulate(seen[:, ::-1], axis=1)[:, ::-1]


def fit(langs: list[str], x: np.ndarray, letters: np.ndarray, heads: list[str], centroids: int = CENTROIDS) -> Model:
    """From the profiles, numbers of letters and beginnings of labelled rows."""
    keep = np.flatnonzero(letters > 0)
    langs, x, letters, heads = [langs[k] for k in keep], x[keep], letters[keep], [heads[k] for k in keep]
    names = sorted(set(langs))
    label = np.array([names.index(lang) for lang in langs], int)
    model = _centred(names, label, x, centroids)
    if names:
        model.reach = _reach(model, label, x, letters, heads, centroids)
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def labelled_sample(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
    """Languages, profiles, letters and beginnings of at most ``sample`` labelled rows per language outside fold 2."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(sample))
    first = ids.groupBy("lang", part.alias("part")).agg(F.min(F.struct(F.xxhash64(F.lit(1), "doc_id"), "doc_id")).alias("m")).select("m.doc_id", F.col("lang").alias("_lang"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(F.col("text").isNotNull())
    chosen = own.join(F.broadcast(first), ["doc_id"]).filter(F.col("lang") == F.col("_lang")).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, texts in in_batches(batch.column(2).to_pylist(), _CHARS, _PIECES):
                x, letters = profiles(texts)
                rows = [np.ascontiguousarray(r).tobytes() for r in x.astype("<f4")]
                yield pa.record_batch([pa.array(ids[at : at + len(texts)], pa.int64()), pa.array(langs[at : at + len(texts)]), pa.array(rows, pa.binary()), pa.array(letters.astype(np.int64)), pa.array([t[:HEAD] for t in texts], pa.string())], ["doc_id", "lang", "x", "letters", "head"])

    rows = chosen.mapInArrow(run, "doc_id long, lang string, x binary, letters long, head string").collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["letters"], bytes(r["x"]), r["head"]))
    once = {(r["lang"], r["doc_id"]): r for r in rows}  # rows that repeat an id count once
    rows = list(once.values())
    x = np.array([np.frombuffer(bytes(r["x"]), "<f4") for r in rows], float).reshape(-1, FEATURES)
    return [r["lang"] for r in rows], x, np.array([r["letters"] for r in rows], int), [r["head"] for r in rows]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    return fit(*labelled_sample(docs, sample))


def identify(docs: DataFrame, model: Model | None = None, with_text: bool = True, prefix: str = "") -> DataFrame:
    """The documents with lang_pred, score and rejected, after ``prefix`` (all three names replaced if they exist).

    Without ``with_text`` the text ends in the worker and only the answers come back.
    """
    small_batches(docs.sparkSession)
    model = model or train(docs)
    share = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the parameters
    added = [prefix + name for name in ("lang_pred", "score", "rejected")]
    rows = docs.drop(*added)
    at = rows.columns.index("text")
    kept = [i for i in range(len(rows.columns)) if with_text or i != at]
    schema = StructType([rows.schema[i] for i in kept]).add(added[0], "string").add(added[1], "double").add(added[2], "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_batches(batch.column(at).to_pylist(), _CHARS, _PIECES):
                lang, score, rejected = share.value.predict(texts)
                own = batch.slice(first, len(texts))
                new = [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.record_batch([*[own.column(i) for i in kept], *new], schema.names)

    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame, model: Model | None = None) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = identify(rows, model or train(docs), with_text=False)
    return found.select("doc_id", held, "lang_pred", "score", "rejected")
