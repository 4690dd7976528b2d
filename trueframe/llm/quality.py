"""Quality classifier: histogram gradient-boosted trees over document statistics.

Defined results. Null or empty text: scored from its (zero) statistics. Without
labels, or with one class only, every document gets the class's smoothed share.
Null ids are scored and count as not held out. Repeated rows are scored alike.
An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import gbt, scoring

CUT = 0.7
NAMES = (
    "log_chars", "log_words", "log_lines", "word_length", "long_words", "upper", "digits", "punctuation", "marks", "bars",
    "exclaims", "stops", "blanks", "non_ascii", "distinct_words", "top_word", "adjacent_repeats", "distinct_lines",
    "words_per_line", "words_per_stop", "distinct_pairs", "capital_words", "marked_words", "short_words", "entropy",
)
_BYTES = np.arange(256)
_UPPER, _DIGIT = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57)
_LOWER, _HIGH = (_BYTES >= 97) & (_BYTES <= 122), _BYTES >= 128
_PUNCT = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_MARKS = np.isin(_BYTES, list(b"#$%&*@^~<>{}[]\\"))


def statistics(text: str) -> list[float]:
    """The document's statistics over its whole text."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = text.split()
    k = max(1, len(words))
    lines = text.split("\n")
    seen = Counter(words)
    letters = max(1, int(counts[_UPPER | _LOWER | _HIGH].sum()))
    share = counts[counts > 0] / n
    stops = int(counts[46] + counts[63])
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), len(raw) / k, sum(len(w) > 15 for w in seen) / k,
        counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / n, counts[_PUNCT].sum() / n, counts[_MARKS].sum() / n, counts[124] / k,
        counts[33] / k, stops / k, counts[[9, 10, 13, 32]].sum() / n, counts[_HIGH].sum() / n, len(seen) / k,
        max(seen.values(), default=0) / k, sum(map(eq, words, words[1:])) / k, len(set(lines)) / len(lines),
        k / len(lines), k / (1 + stops), len(set(zip(words, words[1:]))) / k, sum(map(str.isupper, seen)) / max(1, len(seen)),
        sum(w[-1] in "#$%&*!|" for w in words) / k, sum(len(w) <= 3 for w in seen) / max(1, len(seen)), float(-(share * np.log(share)).sum()),
    ]


def features(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(NAMES))


def train(docs: DataFrame, labels: DataFrame, rows: int = scoring.SAMPLE) -> gbt.Trees:
    """Fit on at most ``rows`` labelled documents that are not held out."""
    x, y, _ = scoring.matrix(scoring.sample(docs, labels, "quality", rows), features, len(NAMES))
    return gbt.fit(x, y)


def score(docs: DataFrame, model: gbt.Trees, cut: float = CUT) -> DataFrame:
    return scoring.scored(docs, lambda texts: gbt.sigmoid(model.raw(features(texts))), cut)


def accepted(docs: DataFrame, model: gbt.Trees, cut: float = CUT) -> DataFrame:
    """The documents whose score reaches the cut, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(gbt.sigmoid(model.raw(features(texts))) >= cut))

    return docs.mapInArrow(run, docs.schema)
