"""Secrets: patterns give base findings, a character network judges every candidate.

Candidates are the base findings and all runs of 16 or more characters that keys
are written with, or the parts of 16 or more characters of such a run that no
base finding covers. Each is cut out with its context into a window of fixed
width (32 characters before, 64 from its start on, 32 after those), mapped to
character classes, and scored by a small convolutional network in numpy:
embedding, one convolution, maximum over the candidate and over the context, a
logistic unit. A candidate of more than 64 characters has windows at every 32nd
character and one that ends with it; its score is the largest of theirs. The
network is trained here on labelled findings made by a seeded generator, short
ones and runs of several pieces; the threshold is the largest that keeps
``RECALL`` on findings of both kinds held out from training.

Base findings always stay, whatever their score; other candidates are findings
of kind ``scored`` if they reach the threshold.

A row in, a row out, over whole texts; candidates are scored in bounded groups.

Defined results: a null text counts as empty; a text without candidates has no
spans and the digest of the empty string; repeated rows are scanned each. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds, their patterns, the group measured, its least length.
BASE = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
PATTERNS = [(kind, re.compile(p), group, least) for kind, p, group, least in BASE]
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Least length of a candidate; characters before a window's piece, of the piece, after it, between
#: the pieces of a long candidate; recall that calibration keeps.
LEAST, BEFORE, AFTER, BEHIND, STEP, RECALL = 16, 32, 64, 32, 32, 0.99
CLASSES, WIDTH, FILTERS, EMBED = 72, 5, 24, 12
#: Class of each character code: letters and digits by themselves, the rest in few classes.
CLASS = np.full(256, 70, dtype=np.int64)
for _i, _c in enumerate(string.ascii_letters + string.digits + "+/_=-:\"'", 1):
    CLASS[ord(_c)] = _i
CLASS[[32, 9, 10, 13]] = 71


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of start, then kind as listed."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def window(text: str, start: int, end: int) -> tuple[np.ndarray, int]:
    """Character classes of the window, and how many of them are the candidate's."""
    out = np.zeros(BEFORE + AFTER + BEHIND, dtype=np.int64)
    piece = text[max(0, start - BEFORE) : start + AFTER + BEHIND]
    at = BEFORE - min(start, BEFORE)
    codes = np.frombuffer(piece.encode("latin-1", "replace"), dtype=np.uint8)
    out[at : at + len(codes)] = CLASS[codes]
    return out, min(end - start, AFTER)


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """Where the windows of a candidate have their pieces: all of it, overlapping."""
    starts = [*range(start, max(start + 1, end - AFTER), STEP), *([end - AFTER] if end - start > AFTER else [])]
    return [(a, min(end, a + AFTER)) for a in starts]


class Network:
    """Embedding, convolution, two maxima, logistic unit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (CLASSES, EMBED)),
            "k": r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)),
            "b": np.zeros(FILTERS),
            "o": r.normal(0, 0.1, 2 * FILTERS),
            "c": np.zeros(1),
        }
        self.threshold = 0.5

    def _forward(self, x: np.ndarray, size: np.ndarray):
        e = self.p["e"][x]
        n, length, _ = e.shape
        steps = length - WIDTH + 1
        cols = np.concatenate([e[:, i : i + steps] for i in range(WIDTH)], axis=2)
        h = np.maximum(cols @ self.p["k"] + self.p["b"], 0)
        place = np.arange(steps)
        inside = (place >= BEFORE) & (place < BEFORE + np.maximum(size[:, None] - WIDTH + 1, 1))
        a = np.where(inside[:, :, None], h, -1.0)
        c = np.where(inside[:, :, None], -1.0, h)
        ia, ic = a.argmax(1), c.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, ia[:, None], 1)[:, 0], np.take_along_axis(c, ic[:, None], 1)[:, 0]], axis=1)
        z = pooled @ self.p["o"] + self.p["c"][0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), cols, h, ia, ic, pooled

    def score(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 512], size[i : i + 512])[0] for i in range(0, len(x), 512)]
        return np.concatenate([*parts, np.empty(0)])

    def fit(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, rounds: int = 6, batch: int = 128, rate: float = 5e-3) -> None:
        r = np.random.default_rng(11)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(rounds):
            for pick in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                t += 1
                g = self._gradients(x[pick], size[pick], y[pick])
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, cols, h, ia, ic, pooled = self._forward(x, size)
        d = (p - y) / len(y)
        up = d[:, None] * self.p["o"][None]
        dh = np.zeros_like(h)
        rows, f = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
        np.add.at(dh, (rows, ia, f), up[:, :FILTERS])
        np.add.at(dh, (rows, ic, f), up[:, FILTERS:])
        dh *= h > 0
        dcols = dh @ self.p["k"].T
        de = np.zeros_like(self.p["e"])
        steps = h.shape[1]
        for i in range(WIDTH):
            np.add.at(de, x[:, i : i + steps], dcols[:, :, i * EMBED : (i + 1) * EMBED])
        return {
            "e": de,
            "k": np.tensordot(cols, dh, ((0, 1), (0, 1))),
            "b": dh.sum((0, 1)),
            "o": pooled.T @ d,
            "c": np.array([d.sum()]),
        }


def findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): half of them keys in context, half long runs that are none."""
    r = np.random.default_rng(seed)
    letters, syllables = string.ascii_letters + string.digits, ["er", "on", "the", "an", "ti", "re", "ing", "ed", "ou", "ca", "mo", "sta", "ly", "pre", "for", "con"]

    def pick(of, k: int) -> str:
        return "".join(of[i] for i in r.integers(0, len(of), k))

    def word() -> str:
        return pick(syllables, int(r.integers(1, 5)))

    out = []
    for i in range(n):
        label = i % 2
        size = int(r.integers(16, 65))
        if label:
            value = [lambda: pick(letters, size), lambda: pick("0123456789abcdef", size), lambda: pick(letters + "+/", size),
                     lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: pick(letters + "_-", size)][r.integers(0, 5)]()
            lead = ["key: ", "token=", "password = \"", "secret: '", "Authorization: Bearer ", word() + " ", "api_key=", "", "use "][r.integers(0, 9)]
        else:
            value = [lambda: "".join(word() for _ in range(9)), lambda: "-".join(word() for _ in range(6)), lambda: "/".join(word() for _ in range(6)),
                     lambda: pick("-=_", 1) * size, lambda: "".join(word().title() for _ in range(6)), lambda: "_".join(word() for _ in range(6)).upper(),
                     lambda: "2024-01-" + "-".join(f"{k:02d}" for k in r.integers(0, 60, 6))][r.integers(0, 7)]()[:64].ljust(16, "e")
            lead = ["", word() + " ", "see ", "http://", "name: ", "the ", "path=", "class "][r.integers(0, 8)]
        text = " ".join(word() for _ in range(int(r.integers(0, 8)))) + " " + lead
        start = len(text)
        text += value + [" ", ".", "\"", "\n", ""][r.integers(0, 5)] + " ".join(word() for _ in range(int(r.integers(0, 8))))
        out.append((text, start, start + len(value), label))
    return out


def long_findings(n: int, seed: int) -> list[tuple[str, int, int, int, int, int]]:
    """(text, start, end, label, start and end of the key): runs of several pieces, half of them with a key among these."""
    r, out = np.random.default_rng(seed), []
    keys, none = ([f for f in findings(4 * n, seed + 1000) if f[3] == y and f[2] - f[1] >= (32 if y else 16)] for y in (1, 0))
    for i in range(n):
        rest = [t[a:b] for t, a, b, _ in (none[int(k)] for k in r.integers(0, len(none), int(r.integers(2, 5))))]
        # some runs are of one kind of piece only
        rest = [x.replace(" ", "") for x in (rest[:1] * len(rest) if r.random() < 0.2 else rest)]
        text, a, b, _ = keys[int(r.integers(0, len(keys)))]
        at = int(r.integers(0, len(rest) + 1))
        key = text[a:b] if i % 2 else ""
        glue = "/-_="[int(r.integers(0, 4))]
        run = glue.join(rest[:at] + [key] * (i % 2) + rest[at:])
        before = len(glue.join(rest[:at])) + (at > 0) if key else 0
        lead, behind = text[:a], text[b:]
        if not i % 2:
            lead = lead.rsplit(" ", 1)[0] + " "
        out.append((lead + run + behind, len(lead), len(lead + run), i % 2, len(lead) + before, len(lead) + before + len(key)))
    return out


def _windows(found) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """The windows of long findings as findings, and the finding of each. A window has label 1 if it holds LEAST characters of a key or more."""
    cut, of = [], []
    for i, (text, start, end, label, a, b) in enumerate(found):
        for x, y in pieces(start, end):
            cut.append((text, x, y, int(label and min(y, b) - max(x, a) >= min(LEAST, b - a))))
            of.append(i)
    return cut, of


def _arrays(found) -> tuple[np.ndarray, np.ndarray]:
    cut = [window(t, a, b) for t, a, b, *_ in found]
    return np.array([w for w, _ in cut]).reshape(-1, BEFORE + AFTER + BEHIND), np.array([s for _, s in cut], dtype=np.int64)


def scores(network: Network, found: list[tuple[str, int, int]]) -> np.ndarray:
    """The largest score of each finding's windows, computed for a bounded number of windows at a time."""
    out, held, of = np.zeros(len(found)), [], []

    def flush() -> None:
        np.maximum.at(out, of, network.score(*_arrays(held)))
        held.clear()
        of.clear()

    for i, (text, start, end) in enumerate(found):
        for a, b in pieces(start, end):
            held.append((text, a, b))
            of.append(i)
            if len(held) == 2048:
                flush()
    if held:
        flush()
    return out


@lru_cache(1)
def trained() -> Network:
    """The network after training and calibration; the same wherever it runs."""
    network, learn, check = Network(), findings(4000, 1) + _windows(long_findings(1000, 3))[0], findings(2000, 2)
    network.fit(*_arrays(learn), np.array([f[3] for f in learn], dtype=float))
    long = [f for f in long_findings(600, 4) if f[3]]
    score = np.concatenate([network.score(*_arrays(check)), scores(network, [f[:3] for f in long])])
    check = check + long
    keys = np.sort(score[np.array([f[3] for f in check]) == 1])
    network.threshold = float(keys[int(np.floor((1 - RECALL) * len(keys)))])
    return network


def scan(text: str | None, network: Network) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """(base spans, all spans with scores)."""
    text = text or ""
    base = base_spans(text)
    taken: list[list[int]] = []  # what base findings cover, in disjoint intervals
    for _, a, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    more, i = [], 0
    for m in CANDIDATE.finditer(text):
        at = m.start()
        while i < len(taken) and taken[i][1] <= at:
            i += 1
        k = i
        while k < len(taken) and taken[k][0] < m.end():
            if taken[k][0] - at >= LEAST:
                more.append(("scored", at, taken[k][0]))
            at = max(at, taken[k][1])
            k += 1
        if m.end() - at >= LEAST:
            more.append(("scored", at, m.end()))
    every = base + more
    kept = []
    for (kind, a, b), s in zip(every, scores(network, [(text, a, b) for _, a, b in every]), strict=True):
        if kind != "scored" or s >= network.threshold:
            kept.append((kind, a, b, float(s)))
    rank = {kind: i for i, kind in enumerate([k for k, *_ in BASE] + ["scored"])}
    return base, sorted(kept, key=lambda k: (k[1], rank[k[0]]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, base and findings: arrays of (kind, start, end) and (kind, start, end, score)."""
    held = docs.sparkSession.sparkContext.broadcast(trained())
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [scan(t, held.value) for t in batch["text"]]
            yield pd.DataFrame({
                "id": batch["id"],
                "base": [[{"kind": k, "start": a, "end": b} for k, a, b in base] for base, _ in made],
                "findings": [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in kept] for _, kept in made],
            })

    span = "kind: string, start: long, end: long"
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, base array<struct<{span}>>, findings array<struct<{span}, score: double>>").withColumnRenamed("id", id)


def _of_kind(kind: str):
    return F.filter("base", lambda s: s["kind"] == kind)


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts of base findings, their digest, and all spans."""

    def joined(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k, *_ in BASE]
    return found.select(F.col(id), *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("findings").alias("spans"))
