"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is a fixed list of insults plus word stems learned from the
labelled rows that are not held out: beginnings of words that stand almost only
in toxic documents. Words are looked up as written and with digits and signs in
place of letters undone.

Defined results. Null or empty text: scored from its (zero) features. Without
labels, or with one class only, every document gets the same score. Null ids are
scored and count as not held out. Repeated rows are scored alike. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt, scoring

CUT = 0.3
# Common insults, and second-person words of the four languages.
INSULTS = frozenset(
    "idiot idiots moron morons loser losers stupid dumb fool fools pathetic worthless clown clowns trash garbage scum "
    "disgusting filthy vermin pig pigs rat rats coward liar creep freak ugly imbecile jerk bastard bitch whore slut shit "
    "crap damn asshole fuck fucking dimwit halfwit brainless retard useless".split())
YOU = frozenset("you your yours you're u ur yourself du dich dir dein deine sie ihr tu toi te ton ta tes vous votre vos usted tú tus ti".split())
_UNDO = str.maketrans("013457@$!|+", "oieastasiit")
_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[^\W\d_]+[\d@$!*._\-|+]+[^\W\d_]+")
#: Learned stems: their lengths, how many at most, and the support they need.
STEM_LENGTHS, STEMS, SUPPORT, LEAST_SHARE = (4, 5, 6, 7, 8, 99), 400, 8, 0.85
NAMES = (
    "log_words", "insults", "log_insults", "distinct_insults", "stems", "log_stems", "distinct_stems", "obfuscated", "log_obfuscated",
    "mixed", "you", "near_you", "close_hits", "hits", "hit_span", "upper", "capital_words", "exclaims", "questions", "punctuation", "marks", "digits",
)
_BYTES = np.arange(256)
_UPPER, _LETTER = (_BYTES >= 65) & (_BYTES <= 90), ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_PUNCT = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~_DIGIT
PLAIN, INSULT, STEM, SECOND, HIDDEN, MIXED = range(6)


class Codes(dict):
    """Class of each word as written; remembered, and forgotten when many."""

    def __init__(self, stems: frozenset[str]):
        self.stems = stems

    def __missing__(self, word: str) -> int:
        plain = _EDGE.sub("", word.lower())
        if plain in INSULTS:
            code = INSULT
        elif any(plain[:n] in self.stems for n in STEM_LENGTHS):
            code = STEM
        elif plain in YOU:
            code = SECOND
        else:
            undone = re.sub(r"\W|_", "", word.lower().translate(_UNDO))
            hidden = undone != plain and (undone in INSULTS or undone.rstrip("i") in INSULTS)
            code = HIDDEN if hidden else MIXED if _INNER.search(word) else PLAIN
        if len(self) > 400_000:
            self.clear()
        self[word] = code
        return code


@dataclass
class Features:
    """Dense features of whole texts; picklable, with the word memory per process."""

    stems: frozenset[str]
    codes: Codes | None = field(default=None, compare=False)

    def __getstate__(self):
        return {"stems": self.stems, "codes": None}

    def one(self, text: str) -> list[float]:
        raw = text.encode()
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        n, letters = max(1, len(raw)), max(1, int(counts[_LETTER].sum()))
        words = text.split()
        k = max(1, len(words))
        code = np.fromiter(map(self.codes.__getitem__, words), np.int8, len(words))
        at = [np.flatnonzero(code == c) for c in range(6)]
        hits = np.flatnonzero((code == INSULT) | (code == STEM) | (code == HIDDEN))
        near, close = 0.0, 0.0
        if len(hits) and len(at[SECOND]):
            place = np.searchsorted(at[SECOND], hits)
            after = at[SECOND][np.minimum(place, len(at[SECOND]) - 1)]
            before = at[SECOND][np.maximum(place - 1, 0)]
            gap = np.minimum(abs(after - hits), abs(before - hits))
            near, close = 1 / float(gap.min()), float((gap <= 8).mean())
        span = float(hits[-1] - hits[0] + 1) / k if len(hits) else 0.0
        return [
            np.log1p(len(words)), len(at[INSULT]) / k, np.log1p(len(at[INSULT])), len({words[i].lower() for i in at[INSULT]}),
            len(at[STEM]) / k, np.log1p(len(at[STEM])), len({words[i].lower() for i in at[STEM]}),
            len(at[HIDDEN]) / k, np.log1p(len(at[HIDDEN])), len(at[MIXED]) / k, len(at[SECOND]) / k, near, close, len(hits) / k, span,
            counts[_UPPER].sum() / letters, sum(map(str.isupper, words)) / k, counts[33] / k, counts[63] / k, counts[_PUNCT].sum() / n,
            counts[[35, 36, 37, 38, 42, 64]].sum() / n, counts[_DIGIT].sum() / n,
        ]

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.codes is None:
            self.codes = Codes(self.stems)
        return np.array([self.one(t) for t in texts], dtype=float).reshape(len(texts), len(NAMES))


@dataclass
class Model:
    features: Features
    trees: gbt.Trees
    calibration: gbt.Isotonic

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.calibration(self.trees.raw(self.features(texts)))


def learned_stems(rows: DataFrame) -> frozenset[str]:
    """Beginnings of words whose documents are nearly all toxic; at most ``STEMS``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{4,}"), F.lit(0)))
    starts = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(*[F.substring(w, 1, n) for n in STEM_LENGTHS]))))
    counted = rows.select("label", F.explode(starts).alias("stem")).groupBy("stem").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n"))
    rate = (F.col("toxic") + 0.5) / (F.col("n") + 1)
    top = counted.filter((F.col("toxic") >= SUPPORT) & (rate >= LEAST_SHARE)).orderBy(F.desc("toxic"), "stem").limit(STEMS)
    return frozenset(r["stem"] for r in top.collect())


def train(docs: DataFrame, labels: DataFrame, rows: int = scoring.SAMPLE) -> Model:
    """Stems, trees and calibration from at most ``rows`` labelled documents that are not held out.

    Trees are fitted on three quarters of them, the calibration on the rest.
    """
    chosen = scoring.sample(docs, labels, "toxic", rows)
    extract = Features(learned_stems(chosen))
    x, y, fold = scoring.matrix(chosen, extract, len(NAMES))
    trees = gbt.fit(x[fold > 0], y[fold > 0])
    return Model(extract, trees, gbt.isotonic(trees.raw(x[fold == 0]), y[fold == 0]))


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    return scoring.scored(docs, model, cut)
