"""Toxicity scores from a counterfactual-regularised linear classifier.

Fitting uses a bounded sample of labelled rows (``FIT_ROWS``, the smallest hashes
of the id). A text's features are its distinct words and their beginnings of 4 to
8 characters, as endings vary. Features that speak for the label beyond chance
are chosen by aggregation in Spark; the sample then comes to the driver as short
lists of their places only. A logistic model with an L1 penalty and weights that
are not negative is fitted in numpy by proximal gradient steps: toxicity is the
presence of something, so that no amount of other words makes up for it.
Counterfactuals: in each labelled sentence that names a group, the identity term
is swapped for another one, and the squared change of the sentence's score, from
all features before and after the swap (the term, its beginnings, and what other
words of the sentence share with them), is penalised, so that naming a group
hardly moves a score. All identity terms are in the vocabulary
whatever their counts, and each term is paired with every other one at least once.

Scoring is a row in, a row out, over whole texts, with the fitted words as a
small dictionary of at most ``WORDS`` entries.

Defined results: null and empty texts score the model's intercept; null ids and
labels never enter the fit; without labelled rows of both classes every score is
the rate of toxic labels (0 without labels); labels repeated for an id count
toxic if any is; repeated documents are scored each; extra columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are fitted on, features of the model, rows that a feature must
#: occur in, its least deviation from chance in standard errors, lengths of beginnings.
FIT_ROWS, WORDS, MIN_ROWS, TELLING, STARTS = 20_000, 2_000, 3, 3.0, (4, 5, 6, 7, 8)
#: What a toxic row weighs in the fit, for a clean one: missing one costs more.
TOXIC_SHARE = 4.0
#: Penalties on weights and on changes under a swap; the score that predicts 1.
L1, SWAP, CUT = 1e-4, 1.0, 0.3
#: Words that name a group without saying anything of it, in the languages of the corpus.
IDENTITY = (
    "women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists",
    "immigrants", "refugees", "gay", "lesbian", "straight", "transgender", "black", "white",
    "asian", "latino", "african", "european", "american", "deaf", "blind", "disabled", "old", "young",
    "frauen", "männer", "muslime", "juden", "christen", "einwanderer", "flüchtlinge", "schwule", "lesben", "behinderte",
    "femmes", "hommes", "musulmans", "juifs", "chrétiens", "immigrés", "réfugiés", "homosexuels", "lesbiennes", "handicapés",
    "mujeres", "hombres", "musulmanes", "judíos", "cristianos", "inmigrantes", "refugiados", "homosexuales", "lesbianas", "discapacitados",
)
_words = re.compile(r"[^\W_]+").findall
_sentences = re.compile(r"[.!?\n]").split


def features(text: str | None) -> set[str]:
    """Distinct words, and beginnings of longer ones, which end in ``~``."""
    words = set(_words((text or "").lower()))
    return _with_starts(words)


def _with_starts(words: set[str]) -> set[str]:
    return words | {w[:k] + "~" for w in words for k in STARTS if len(w) > k}


#: All that an identity term can add to a text's features.
_OF_TERMS = _with_starts(set(IDENTITY))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept + sum(self.weights[f] for f in sorted(features(text) & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def swaps(sentence: set[str]) -> Iterator[tuple[str, str]]:
    """Each identity term of a sentence with the term that stands in for it."""
    for term in sorted(sentence.intersection(IDENTITY)):
        at = IDENTITY.index(term)
        step = 1 + zlib.crc32(" ".join(sorted(sentence)).encode()) % (len(IDENTITY) - 1)
        yield term, IDENTITY[(at + step) % len(IDENTITY)]


def named(text: str | None) -> list[tuple[list[str], list[str]]]:
    """For each sentence that names a group: its identity terms, and those features of its other words that a term has too."""
    out = []
    for sentence in _sentences((text or "").lower()):
        words = set(_words(sentence))
        if terms := words.intersection(IDENTITY):
            out.append((sorted(terms), sorted(_with_starts(words - terms) & _OF_TERMS)))
    return out


def changed(terms: set[str], others: set[str], term: str, other: str) -> tuple[tuple[str, int], ...]:
    """The features that a sentence loses (-1) and gains (1) if ``other`` stands in for ``term``."""
    before, after = (_with_starts(t) | others for t in (terms, terms - {term} | {other}))
    return tuple(sorted([(f, -1) for f in before - after] + [(f, 1) for f in after - before]))


def fit_linear(rows: list[list[int]], labels: list[int], width: int, changes: list[tuple[list[int], list[int], float]], steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept. ``changes`` holds (places, signs, weight) of swaps: what a swap takes and adds."""
    y = np.asarray(labels, dtype=float)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), dtype=np.int64, count=len(row))
    share = np.where(y == 1, TOXIC_SHARE, 1.0)
    share /= share.sum()
    w, b = np.zeros(width), 0.0
    v, vb, t = w.copy(), b, 1.0
    # the curvature is bounded by the largest row of words, and by the swaps
    size = np.bincount(row, minlength=len(rows)) + 1
    swap = np.repeat(np.arange(len(changes)), [len(places) for places, _, _ in changes])
    at = np.array([k for places, _, _ in changes for k in places], dtype=np.int64)
    sign = np.array([k for _, signs, _ in changes for k in signs], dtype=float)
    often = np.array([weight for _, _, weight in changes], dtype=float)
    rate = 1 / (0.25 * float((share * size).sum()) + 2 * SWAP * float(often[swap].sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[col], len(rows)) + vb, -30, 30)))
        g = (p - y) * share
        grad = np.bincount(col, g[row], width)
        change = 2 * SWAP * often * np.bincount(swap, sign * v[at], len(changes))
        grad += np.bincount(at, sign * change[swap], width)
        new = v - rate * grad
        new = np.maximum(new - rate * L1, 0)
        newb = vb - rate * g.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / after * (new - w), newb + (t - 1) / after * (newb - b)
        w, b, t = new, newb, after
    return w, b


def held_out(id: str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of the labelled rows that are not held out."""
    picked = (
        labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(id))
        .groupBy(F.col(id).alias("id"))
        .agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(FIT_ROWS)
    )
    @F.pandas_udf("words array<string>, named array<struct<terms: array<string>, others: array<string>>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        made = [(sorted(features(t)), [{"terms": terms, "others": others} for terms, others in named(t)]) for t in texts]
        return pd.DataFrame(made, columns=["words", "named"])

    # at most FIT_ROWS narrow rows, hence the broadcast
    rows = (
        docs.select(F.col(id).alias("id"), F.col(text).alias("t"))
        .join(F.broadcast(picked), "id")
        .select("y", of("t").alias("f"))
        .select("y", "f.*")
        .checkpoint()
    )
    totals = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    n, toxic = int(totals[0]), int(totals[1])
    if not 0 < toxic < n:
        rate = min(max(toxic / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Model({}, float(np.log(rate / (1 - rate))))
    counts = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("tox"))
    rate = toxic / n
    telling = (F.col("tox") - F.col("df") * rate) / F.sqrt(F.col("df") * rate * (1 - rate))
    vocabulary = [r.word for r in counts.where((F.col("df") >= MIN_ROWS) & (telling >= TELLING)).orderBy(telling.desc(), "word").limit(WORDS).collect()]
    vocabulary += [w for w in IDENTITY if w not in set(vocabulary)]
    place = {w: i for i, w in enumerate(vocabulary)}
    known = F.array(*map(F.lit, vocabulary))
    sample = rows.select("y", F.array_intersect("words", known).alias("words"), "named").toLocalIterator()
    x, y, often = [], [], {}

    def swapped(terms: set[str], others: set[str], a: str, c: str) -> None:
        if change := tuple((place[f], sign) for f, sign in changed(terms, others, a, c) if f in place):
            often[change] = often.get(change, 0.0) + 1.0 / n

    for r in sample:
        x.append([place[w] for w in r.words])
        y.append(r.y)
        for sentence in r.named:
            for a, c in swaps(set(sentence.terms)):
                swapped(set(sentence.terms), set(sentence.others), a, c)
    for a, c in zip(IDENTITY, IDENTITY[1:] + IDENTITY[:1]):
        swapped({a}, set(), a, c)
    changes = [([k for k, _ in change], [sign for _, sign in change], weight) for change, weight in sorted(often.items())]
    w, b = fit_linear(x, y, len(vocabulary), changes)
    return Model({vocabulary[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-6)}, float(b))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each row's whole text."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return docs.withColumn(out, of(F.col(text)))


def judge(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(docs.select(F.col(id), F.col(text)), fit(docs, labels, id, text), text)
    return scored.select(
        F.col(id), held_out(id).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def clean(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that the model does not reject, with their columns."""
    name = "score" + "_" * max(map(len, docs.columns), default=0)
    return score(docs, fit(docs, labels, id, text), text, name).where(F.col(name) < CUT).drop(name)
