"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

Patterns give the base spans (see ``base_spans``). The network, trained in numpy from labelled spans, scores every
character as outside, or as first or inner character of one of the kinds, which are the base kinds, secrets (keys,
tokens, passwords) and identity numbers (social security, bank accounts). It runs on windows of ``WINDOW`` characters that overlap by half; of a character that several
windows cover the scores are averaged, those nearer to a window's middle counting more, and one Viterbi run with the
CRF's transitions over the whole text gives all its tags, so no seam is decoded twice. Model spans that touch no base
span and meet their kind's own terms (``valid``: those of the patterns, a card's checksum say, whatever the form) are
added.

A learned gate tells which windows are run: characters are marked where they are a digit or ``@``, and where the
summed weights of the character trigrams around them reach what nearly all spans without digits reach. Windows that
hold a marked character and the windows beside them are run, whatever the length of the text. The weights come with the
package; ``python -m chiasma.llm.pii`` makes them anew from generated windows and from a bounded sample of real windows
labelled by the patterns, seeded.

One scan and one pass, nothing is shuffled; the weights (0.1 MB) go along with the task. Equal texts get equal spans in
every table. Defined results: null text counts as empty and has no spans; a very long text is handled alone, in memory
in proportion to it; a null ``doc_id`` is carried; repeated rows are answered each; an empty table gives no rows; other
columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import io
import pkgutil
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chars import code_points
from ._encode import in_batches
from ._store import small_batches

#: The base kinds, and those that only the network finds.
KINDS = ("email", "ip", "card", "phone")
SECRET, ID = 4, 5
NAMES = (*KINDS, "secret", "id")
WINDOW, STRIDE = 96, 48
#: Weights of hashed trigrams that the gate has, characters to either side that it sums, and before a span that it counts.
GATE, SPREAD, LEAD = 1 << 14, 6, 10
#: Share of the spans without digits that the gate may leave unmarked, in training.
MISSED = 0.01
HIDDEN = 24
TAGS = 1 + 2 * len(NAMES)
#: Windows run at once, and characters and texts handled at once.
ROWS, _CHARS, _TEXTS, _CELLS = 1024, 500_000, 500, 1_000_000
#: Real windows that training takes at most.
REAL = 1200
WEIGHTS = "pii_weights.npz"

# ---- base patterns ---------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, so the search skips the rest of the run
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TRIGGER = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches that hold, by kind and start."""
    out = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):  # an address ends where its @ and domain do; its start is the run before
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                free = m.end()
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


# ---- network ---------------------------------------------------------------------------------------------------

# classes of characters: each ASCII character its own, then letters, digits, space and the rest beyond ASCII
_CLASSES = 132
_PAD = 131


def classes(text: str) -> np.ndarray:
    c = code_points(text)
    out = np.minimum(c, 127).astype(np.uint8)
    beyond = np.flatnonzero(c > 127)
    if len(beyond):
        once, which = np.unique(c[beyond], return_inverse=True)
        kinds = [128 if ch.isalpha() else 129 if ch.isdigit() else 130 for ch in map(chr, once.tolist())]
        out[beyond] = np.array(kinds, np.uint8)[which]
    return out


def trigrams(c: np.ndarray) -> np.ndarray:
    """Of each character (class) the hashed number of the trigram around it."""
    wide = np.full(len(c) + 2, _PAD, np.uint32)
    wide[1:-1] = c
    code = (wide[:-2] * np.uint32(_CLASSES) + wide[1:-1]) * np.uint32(_CLASSES) + wide[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - GATE.bit_length() + 1)


def gate_sums(c: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The gate's weights summed over the trigrams about each character."""
    total = np.zeros(len(c) + 2 * SPREAD + 2)
    np.cumsum(weights[trigrams(c)], out=total[SPREAD + 1 : SPREAD + 1 + len(c)])
    total[SPREAD + 1 + len(c) :] = total[SPREAD + len(c)]
    return total[2 * SPREAD + 1 : 2 * SPREAD + 1 + len(c)] - total[: len(c)]


def fit_gate(examples: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, float]:
    """Log odds of trigrams in spans, or just before them, against elsewhere; and the sum that counts as marked."""
    odds = np.full((2, GATE), 0.5)
    known = []
    for text, spans in examples:
        c = classes(text)
        own = np.zeros(len(c), bool)
        for _, a, b in spans:
            own[max(0, a - LEAD) : b] = True
        t = trigrams(c)
        odds += np.stack([np.bincount(t[own == side], minlength=GATE) for side in (False, True)])
        known.append((text, c, spans))
    share = odds / odds.sum(axis=1, keepdims=True)
    weights = np.clip(np.log(share[1] / share[0]), -4, 4).astype(np.float32)
    tops = []
    for text, c, spans in known:
        bare = [(a, b) for _, a, b in spans if a > 0 and b < len(text) and not _TRIGGER.search(text[a:b])]
        if bare:
            sums = gate_sums(c, weights)
            tops += [float(sums[max(0, a - LEAD) : b].max()) for a, b in bare]
    return weights, float(np.quantile(tops, MISSED)) if tops else np.inf


@dataclass
class Model:
    """Per direction: input table (classes x 4H), recurrence (H x 4H); output (2H x tags), bias, transitions; the gate's
    weights and the sum from which a character is marked."""

    table: list[np.ndarray]
    recur: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray
    gate: np.ndarray
    least: float

    def marked(self, c: np.ndarray) -> np.ndarray:
        """Places of the characters near which windows are run."""
        sure = ((c >= 48) & (c <= 57)) | (c == 64)  # digits and @
        return np.flatnonzero(sure | (gate_sums(c, self.gate) >= self.least))

    def states(self, x: np.ndarray, d: int, keep: bool = False):
        """x: rows x time. Gates are in, forget, out (as halved tanh) and cell."""
        n, t = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        hs, log = np.empty((t, n, HIDDEN), np.float32), []
        for s in range(t) if d == 0 else range(t - 1, -1, -1):
            z = self.table[d][x[:, s]]
            z += h @ self.recur[d]
            np.tanh(z, out=z)
            g = z[:, : 3 * HIDDEN] * 0.5 + 0.5
            was, before = c, h
            c = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * z[:, 3 * HIDDEN :]
            tc = np.tanh(c)
            h = g[:, 2 * HIDDEN :] * tc
            hs[s] = h
            if keep:
                log.append((s, g, z[:, 3 * HIDDEN :], was, before, tc))
        return (hs, log) if keep else hs

    def scores(self, x: np.ndarray) -> np.ndarray:
        """time x rows x tags."""
        h = np.concatenate([self.states(x, 0), self.states(x, 1)], axis=2)
        return h @ self.out + self.bias

    def averaged(self, x: list[np.ndarray], starts: np.ndarray, n: int) -> np.ndarray:
        """Scores of n characters from windows (rows) that begin at ``starts``, weighted towards their middles."""
        total, weight = np.zeros((n + WINDOW, TAGS), np.float32), np.zeros((n + WINDOW, 1), np.float32)
        near = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
        for at in range(0, len(x), ROWS):
            e = self.scores(np.array(x[at : at + ROWS]))
            for k, start in enumerate(starts[at : at + ROWS].tolist()):
                total[start : start + WINDOW] += e[:, k] * near
                weight[start : start + WINDOW] += near
        return total[:n] / np.maximum(weight[:n], 1e-9)

    def decode(self, e: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Best tags of the characters of all runs [start, end); what lies between runs is outside.

        Runs are decoded together, longest first, so that a step takes all that are still going.
        """
        tags = np.zeros(len(e), np.int8)
        order, at = np.argsort(starts - ends, kind="stable"), 0
        while at < len(order):
            longest = int((ends - starts)[order[at]])
            own = order[at : at + max(1, min(ROWS, _CELLS // longest))]
            at += len(own)
            a, size = starts[own], (ends - starts)[own]
            best = e[a] + self.trans[0]  # a run follows an outside character
            back = np.zeros((size[0], len(own), TAGS), np.int8)
            left = np.zeros((len(own), TAGS), np.float32)
            for t in range(1, size[0] + 1):
                going = int(np.searchsorted(-size, -t, side="left"))  # runs longer than t
                left[going : len(best)] = best[going:]
                if t == size[0]:
                    break
                paths = best[:going, :, None] + self.trans[None]
                back[t, :going] = paths.argmax(axis=1)
                best = paths.max(axis=1) + e[a[:going] + t]
            now = (left + self.trans[:, 0]).argmax(axis=1).astype(np.int8)
            for t in range(size[0] - 1, -1, -1):
                going = int(np.searchsorted(-size, -t, side="left"))
                tags[a[:going] + t] = now[:going]
                if t:
                    now[:going] = back[t, np.arange(going), now[:going]]
        return tags


def _allowed() -> np.ndarray:
    """Transitions that tags admit: an inner tag follows the first or inner tag of its kind."""
    ok = np.zeros((TAGS, TAGS), np.float32)
    for j in range(2, TAGS, 2):
        ok[:, j] = -1e4
        ok[j, j] = ok[j - 1, j] = 0
    return ok


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 1600, batch: int = 96, seed: int = 3, rate: float = 0.015, start: Model | None = None) -> Model:
    """From texts with labelled spans (kind, start, end): CRF likelihood, backpropagation through time, Adam.

    ``start``: weights to go on from, of the same kinds or the first of them.
    """
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, spans in examples:
        x = np.full(WINDOW, _PAD, np.uint8)
        y = np.zeros(WINDOW, np.int64)
        own = classes(text[:WINDOW])
        x[: len(own)] = own
        for kind, a, b in spans:
            y[a:b] = 2 + 2 * kind
            y[a] = 1 + 2 * kind
        xs.append(x)
        ys.append(y)
    xs, ys = np.array(xs), np.array(ys)
    w = {}
    for d in (0, 1):
        w[f"t{d}"] = rng.normal(0, 0.3, (_CLASSES, 4 * HIDDEN))
        w[f"t{d}"][:, HIDDEN : 2 * HIDDEN] += 0.5
        w[f"r{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
    w |= {"o": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "b": np.zeros(TAGS), "a": np.zeros((TAGS, TAGS))}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    hard = _allowed()
    if start is not None:
        old = start.out.shape[1]
        w |= {f"t{d}": start.table[d] for d in (0, 1)} | {f"r{d}": start.recur[d] for d in (0, 1)}
        w["o"][:, :old], w["b"][:old], w["a"][:old, :old] = start.out, start.bias, start.trans - hard[:old, :old]
    gate, least = fit_gate(examples)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(xs), batch)
        x, y = xs[pick], ys[pick]
        m = Model([w["t0"], w["t1"]], [w["r0"], w["r1"]], w["o"], w["b"], w["a"] + hard, gate, least)
        (hf, lf), (hb, lb) = m.states(x, 0, True), m.states(x, 1, True)
        h = np.concatenate([hf, hb], axis=2)
        e = h @ m.out + m.bias
        t, n, k = e.shape
        # forward and backward sums give the expected tags and transitions
        al, be = np.empty((t, n, k)), np.zeros((t, n, k))
        al[0] = e[0]
        for s in range(1, t):
            al[s] = _lse(al[s - 1][:, :, None] + m.trans, 1) + e[s]
        for s in range(t - 2, -1, -1):
            be[s] = _lse(m.trans[None] + (e[s + 1] + be[s + 1])[:, None, :], 2)
        z = _lse(al[-1], 1)
        de = np.exp(al + be - z[None, :, None])
        np.add.at(de, (np.arange(t)[:, None], np.arange(n)[None], y.T), -1)
        de = (de / n).astype(np.float32)
        da = np.zeros((k, k))
        for s in range(1, t):
            da += np.exp(al[s - 1][:, :, None] + m.trans + (e[s] + be[s])[:, None, :] - z[:, None, None]).sum(axis=0)
            np.add.at(da, (y[:, s - 1], y[:, s]), -1)
        grads = {"a": (da / n) * (hard == 0), "o": np.tensordot(h, de, ([0, 1], [0, 1])), "b": de.sum(axis=(0, 1))}
        dh = de @ m.out.T
        for d, log in ((0, lf), (1, lb)):
            gr, steps_dz = np.zeros_like(w[f"r{d}"]), np.empty((t, n, 4 * HIDDEN), np.float32)
            back_h, back_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for s, g, cell, was, before, tc in reversed(log):
                gi, gf, go = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
                hh = dh[s][:, d * HIDDEN : (d + 1) * HIDDEN] + back_h
                cc = hh * go * (1 - tc * tc) + back_c
                # a gate is tanh / 2 + 1/2, so its slope is 2 g (1 - g)
                dz = np.concatenate([cc * cell * 2 * gi * (1 - gi), cc * was * 2 * gf * (1 - gf), hh * tc * 2 * go * (1 - go), cc * gi * (1 - cell * cell)], axis=1)
                steps_dz[s] = dz
                gr += before.T @ dz
                back_h, back_c = dz @ m.recur[d].T, cc * gf
            one = np.eye(_CLASSES, dtype=np.float32)[x.T.reshape(-1)]
            grads |= {f"t{d}": one.T @ steps_dz.reshape(t * n, -1), f"r{d}": gr}
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * min(1, 4 * (1 - step / (steps + 1)))
        for name, g in grads.items():
            g = g.astype(np.float32) * min(1.0, 5.0 / (size + 1e-9))
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            w[name] = w[name] - now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return Model([w["t0"], w["t1"]], [w["r0"], w["r1"]], w["o"], w["b"], (w["a"] + hard).astype(np.float32), gate, least)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def labelled_examples(n: int = 8000, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated windows: words with inserted personal data in many forms, labelled, and look-alikes, not labelled."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    chars = lambda xs, a, b: "".join(pick(xs) for _ in range(int(rng.integers(a, b))))
    syllables = "an be co der en fi gar ha in ja ker le mo nu or pa qu re st tion un vi wo xe yon zu é ön ção ñe".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
    plain = lambda: chars("abcdefghijklmnopqrstuvwxyz", 2, 9)
    hexes, mixed_ = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    space = lambda: pick(["", "", " "])

    def card() -> str:
        body = digits(int(pick([15, 15, 15, 18])))
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        gap = pick(["", "", " ", "-", ".", "/"])
        return gap.join(body[i : i + 4] for i in range(0, len(body), 4)) if gap else body

    def email() -> str:
        name = f"{plain()}{pick(['.', '_', '', '-'])}{pick([plain(), digits(2)])}"
        host = f"{plain()}{pick(['', digits(1)])}{pick(['', '', '.' + plain()])}"
        at, dot = pick([("@", "."), ("@", "."), ("@", "."), (" @ ", "."), ("(@)", "."), ("[@]", "[.]"), (" @ ", " . "), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] ")])
        return (name + at + host + "." + pick(["com", "org", "net", "de", "example.com"])).replace(".", dot)

    def ip() -> str:
        return pick([".", ".", ".", ".", " . ", "[.]", ". "]).join(str(int(x)) for x in rng.integers(0, 256, 4))

    def phone() -> str:
        return pick([
            f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(2)}{digits(9)}", f"({digits(3)}) {digits(3)}-{digits(4)}",
            f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(7)}", f"0{digits(3)}/{digits(7)}", f"00{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"+{digits(2)} {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
        ])

    def number() -> str:
        if rng.random() < 0.5:
            return f"{digits(3)}-{digits(2)}-{digits(4)}"
        body = pick(["DE", "FR", "ES", "GB", "IT", "NL", "CH", "AT"]) + digits(2) + pick(["", chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4, 5)]) + digits(int(rng.integers(14, 19)))
        return " ".join(body[i : i + 4] for i in range(0, len(body), 4)) if rng.random() < 0.5 else body

    def secret() -> tuple[str, str, str]:
        value = pick([chars(hexes, 32, 49), chars(mixed_, 20, 44) + digits(1), "AKIA" + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 15, 16) + digits(1), "ghp_" + chars(mixed_, 35, 36) + digits(1), "sk-" + chars(mixed_, 24, 48) + digits(1), plain() + digits(3) + pick("!?#"), chars("abcdefghijklmnopqrstuvwxyz", 10, 24), plain() + plain() + plain() + pick("!?#_")])
        name = pick(["token", "api_key", "apikey", "secret", "password", "passwd", "key", "access_token", "auth"])
        name = name.upper() if rng.random() < 0.2 else name
        quote = pick(['"', '"', "'", ""])
        return f"{name}{space()}{pick(['=', '=', ':'])}{space()}{quote}", value.upper() if rng.random() < 0.1 else value, quote

    makers = (email, ip, card, phone, None, number)
    # numbers, dates, versions, hashes without a name, handles, times, prices, formulas
    others = (
        lambda: chars(hexes, 32, 65), lambda: f"{digits(1)}.{digits(1)}", lambda: digits(4), lambda: digits(3) + "." + digits(2), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: digits(int(rng.integers(1, 13))), lambda: digits(int(rng.integers(20, 40))), lambda: "@" + plain(), lambda: plain() + "@",
        lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}", lambda: f'"{digits(8)}"', lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"+{digits(2)} %", lambda: f"{plain()} = {digits(4)}", lambda: f'{plain()} = "{plain()}{digits(2)}"', lambda: f"({digits(4)})", lambda: f"{digits(3)}-{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}",
        lambda: f"{plain()} at {plain()}", lambda: f"{plain()} dot {plain()}", lambda: f"{pick(['token', 'key', 'secret', 'password', 'auth'])} {plain()}", lambda: f"{plain()}: {plain()}", lambda: f"{plain()}={plain()}", lambda: chars(mixed_, 20, 44),
    )
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    out = []
    while len(out) < n:
        text, spans = "", []
        cut = int(rng.integers(0, 40))
        noise, loud = pick(["", "", "", pick(marks) * int(rng.integers(1, 4))]), rng.random() < 0.06
        while len(text) < WINDOW + 48:
            r = rng.random()
            if r < 0.14:
                kind = int(rng.integers(len(NAMES)))
                lead, made, tail = secret() if kind == SECRET else ("", makers[kind](), "")
                spans.append((kind, len(text) + len(lead), len(text) + len(lead) + len(made)))
                made = lead + made + tail
            elif r < 0.3:
                made = pick(others)()
            else:
                made = word() + pick(["", "", "", ".", ","])
                made = made.capitalize() if rng.random() < 0.2 else made
            made = made.upper() if loud else made
            text += made + (noise if rng.random() < 0.7 else "") + pick([" ", " ", " ", "\n"])
        text, end = text[cut:], cut + WINDOW
        out.append((text[:WINDOW], [(k, max(0, a - cut), min(b, end) - cut) for k, a, b in spans if a < end and b > cut]))
    return out


#: What labels secrets in real windows: a long value after a name that says so.
_NAMED = re.compile(r"(?i)(?:token|key|secret|passw\w*)\s*[=:]\s*[\"']?([a-z0-9_+/-]{16,})")


def real_examples(texts: list[str], most: int = REAL, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most ``most`` windows of real texts, each about a span of the patterns and labelled by them, and by ``_NAMED``."""
    rng = np.random.default_rng(seed)
    out = []
    for text in texts:
        spans = base_spans(text) + [(SECRET, *m.span(1)) for m in _NAMED.finditer(text)]
        for _, a, b in spans:
            start = max(0, a - int(rng.integers(0, max(1, WINDOW - (b - a)))))
            inside = [(k, max(x, start) - start, min(y, start + WINDOW) - start) for k, x, y in spans if x < start + WINDOW and y > start]
            out.append((text[start : start + WINDOW], inside))
    return [out[i] for i in rng.permutation(len(out))[:most].tolist()]


def plain_examples(texts: list[str], most: int = REAL, seed: int = 6) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most ``most`` windows of real texts, one of each text at a random place, labelled like ``real_examples``."""
    rng = np.random.default_rng(seed)
    out = []
    for i in rng.permutation(len(texts))[:most].tolist():
        start = int(rng.integers(0, max(1, len(texts[i]) - WINDOW)))
        spans = base_spans(texts[i]) + [(SECRET, *m.span(1)) for m in _NAMED.finditer(texts[i])]
        inside = [(k, max(a, start) - start, min(b, start + WINDOW) - start) for k, a, b in spans if a < start + WINDOW and b > start]
        out.append((texts[i][start : start + WINDOW], inside))
    return out


def saved(model: Model) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **{f"table{d}": model.table[d].astype(np.float16) for d in (0, 1)}, **{f"recur{d}": model.recur[d].astype(np.float16) for d in (0, 1)}, out=model.out, bias=model.bias, trans=model.trans, gate=model.gate.astype(np.float16), least=np.float32(model.least))
    return out.getvalue()


def loaded(content: bytes) -> Model:
    w = {k: v.astype(np.float32) for k, v in np.load(io.BytesIO(content)).items()}
    return Model([w["table0"], w["table1"]], [w["recur0"], w["recur1"]], w["out"], w["bias"], w["trans"], w["gate"], float(w["least"]))


@cache
def default_model() -> Model:
    """The weights that come with the package."""
    return loaded(pkgutil.get_data(__package__, WEIGHTS))


# ---- spans of a whole text -------------------------------------------------------------------------------------


_AT = re.compile(r"(?i)@|(?<![a-z0-9])at(?![a-z0-9])")
_DOT = re.compile(r"(?i)\.|(?<![a-z0-9])dot(?![a-z0-9])")


def valid(kind: int, own: str) -> bool:
    """Whether a model span meets the terms of its kind, in whatever form it is written."""
    numbers = re.findall("[0-9]+", own)
    n = sum(map(len, numbers))
    if kind == 0:
        at = _AT.search(own, 1)
        return at is not None and _DOT.search(own, at.end()) is not None
    if kind == 1:
        return len(numbers) == 4 and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in numbers)
    if kind == 2:
        return 16 <= n <= 19 and luhn("".join(numbers))
    if kind == SECRET:
        return n > 0 or len(own) >= 8
    return 8 <= n <= 15 if kind == 3 else 9 <= n <= 32


def model_spans(texts: list[str], model: Model, every: bool = False, checked: bool = True) -> list[list[tuple[int, int, int]]]:
    """Spans read off the tags of whole texts. ``every``: run all windows; not ``checked``: without ``valid``."""
    windows, begins = [], []
    runs: list[tuple[int, int, int, int]] = []  # text, its first character, where its scores begin and end
    end = 0
    for i, text in enumerate(texts):
        own = classes(text)
        near = np.arange(len(text)) if every else model.marked(own)
        if not len(near):
            continue
        n = len(own)
        # windows from each multiple of STRIDE that hold a marked character, and those beside them
        last = max(0, -(-(n - WINDOW) // STRIDE))
        lo = np.clip((near - WINDOW) // STRIDE, 0, last)
        hi = np.clip(near // STRIDE + 1, 0, last)
        mark = np.zeros(last + 2, np.int64)
        np.add.at(mark, lo, 1)
        np.add.at(mark, hi + 1, -1)
        picked = np.flatnonzero(np.cumsum(mark)[: last + 1])
        own = np.concatenate([own, np.full(WINDOW + STRIDE, _PAD, np.uint8)])
        for part in np.split(picked, np.flatnonzero(np.diff(picked) > 2) + 1):
            first = int(part[0]) * STRIDE
            windows += [own[k * STRIDE : k * STRIDE + WINDOW] for k in part.tolist()]
            begins += (end + part * STRIDE - first).tolist()
            size = min(n, int(part[-1]) * STRIDE + WINDOW) - first
            runs.append((i, first, end, end + size))
            end += size + WINDOW  # a gap, so that no window reaches into the next run
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not windows:
        return out
    a, b = np.array([r[2:] for r in runs], np.int64).T
    tags = model.decode(model.averaged(windows, np.array(begins), end), a, b)
    kind = (tags + 1) // 2
    edge = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1), [True]]))
    for p in np.flatnonzero(kind[edge[:-1]]).tolist():
        start, stop = int(edge[p]), int(edge[p + 1])
        i, first, begin, _ = runs[int(np.searchsorted(a, start, side="right")) - 1]
        span = (int(kind[start]) - 1, first + start - begin, first + stop - begin)
        if not checked or valid(span[0], texts[i][span[1] : span[2]]):
            out[i].append(span)
    return out


def all_spans(texts: list[str], model: Model) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base, base and added) of each text, by kind and start."""
    out = []
    for text, more in zip(texts, model_spans(texts, model), strict=True):
        base = base_spans(text)
        added = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]
        out.append((base, sorted(base + added)))
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{NAMES[k]}:{a}:{b}" for k, a, b in spans)


def _mapped(docs: DataFrame, answer, extra: str, model: Model | None, keep: list[str]) -> DataFrame:
    """One pass over the documents: the columns ``keep``, then those that ``answer(text, base, every)`` gives."""
    model = model or default_model()
    small_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    at = docs.columns.index("text")
    places = [docs.columns.index(c) for c in keep]
    schema = docs.select(*keep).schema
    for c in extra.split(", "):
        schema = schema.add(*c.split())
    types = {"long": pa.int64(), "string": pa.string()}
    kinds = [types[c.split()[1]] for c in extra.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_batches(batch.column(at).to_pylist(), _CHARS, _TEXTS):
                rows = [answer(t, *s) for t, s in zip(texts, all_spans(texts, share.value), strict=True)]
                own = batch.slice(first, len(texts))
                new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch([*[own.column(i) for i in places], *new], schema.names)

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base spans), n_secret, n_id, n_found (of all spans), base and spans
    (all of them) as text, kind:start:end by kind and start."""

    def answer(text, base, every):
        counts = [sum(k == i for k, _, _ in (base if i < len(KINDS) else every)) for i in range(len(NAMES))]
        return (*counts, len(every), shown(base), shown(every))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    extra = ", ".join([f"n_{k} long" for k in (*NAMES, "found")] + ["base string", "spans string"])
    return _mapped(own, answer, extra, model, ["doc_id"])


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span as the kind in angle brackets; spans that touch are one, of the first's kind."""
    out, free = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= free:
            out += [text[free:a], f"<{NAMES[k].upper()}>"]
        free = max(free, b)
    return "".join(out) + text[free:]


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with personal data in ``text`` replaced (a null text stays null) and ``n_chars`` as it is then."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.withColumn("_pii_blank", F.col("text").isNull())
    found = _mapped(rows, lambda text, base, every: (redacted(text, every),), "_pii_text string", model, [*rest, "_pii_blank"])
    text = F.when(~F.col("_pii_blank"), F.col("_pii_text"))
    made = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", *[f"n_{k}" for k in NAMES[len(KINDS) :]], "n_found")


def main(argv: list[str]) -> None:
    """Make the weights: ``python -m chiasma.llm.pii documents.parquet``; rows of fold 2 are held out and judged.

    With a number of steps after the file training goes on from the package's weights; one thread is fastest
    (``OMP_NUM_THREADS=1``).
    """
    import zlib

    import pyarrow.parquet as pq

    rows = pq.read_table(argv[0], columns=["doc_id", "text"]).to_pylist()
    fold = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 4
    learn, held = ([r["text"] for r in rows if r["text"] and (fold(r) == 2) == out] for out in (False, True))
    steps, start = (int(argv[1]), default_model()) if len(argv) > 1 else (1600, None)
    model = train(labelled_examples() + real_examples(learn) + plain_examples(learn), steps, start=start, rate=0.01 if start else 0.015)
    content = saved(model)
    with open(__file__.rsplit("/", 1)[0] + "/" + WEIGHTS, "wb") as f:
        f.write(content)
    run = sum(len(np.unique(model.marked(classes(t)) // STRIDE)) for t in held) / sum(-(-len(t) // STRIDE) for t in held)
    fresh = labelled_examples(600, seed=77)
    asked = [(s, set(own)) for (t, spans), own in zip(fresh, model_spans([t for t, _ in fresh], loaded(content)), strict=True) for s in spans if s[1] > 0 and s[2] < len(t)]
    print("generated windows not trained on, found exactly by kind:", {n: f"{sum(s in own for s, own in asked if s[0] == k)}/{sum(s[0] == k for s, _ in asked)}" for k, n in enumerate(NAMES)}, f"stretches of {STRIDE} characters marked in held-out texts: {run:.3f}")
    found, base = model_spans(held, loaded(content), checked=False), [base_spans(t) for t in held]
    kept = [[s for s in own if valid(s[0], t[s[1] : s[2]])] for t, own in zip(held, found, strict=True)]
    wanted = sum(map(len, base))
    hit = sum(len(set(a) & set(b)) for a, b in zip(found, base, strict=True))
    extra = [(t, s) for t, own, b in zip(held, found, base, strict=True) for s in own if s[0] < SECRET and s not in b]
    print(f"held-out texts {len(held)}, base spans {wanted}, of them found by the network alone {hit}; its other spans of the base kinds {len(extra)}, valid {sum(valid(s[0], t[s[1] : s[2]]) for t, s in extra)}; secrets {sum(s[0] == SECRET for own in kept for s in own)}")
    for t, s in extra[:20]:
        print(NAMES[s[0]], repr(t[max(0, s[1] - 20) : s[1]]), repr(t[s[1] : s[2]]), repr(t[s[2] : s[2] + 12]))


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
