"""Toxicity by compression distance.

Two zstandard dictionaries share a part trained on ordinary text. Each continues with a part trained on passages of its own class
whose byte grams are peculiar to that class, in any script and across words, and with the words peculiar to it. A window of a document that the first compresses better than the second is the
more toxic the more bytes it saves. Thresholds on the savings and their weights are calibrated on documents that the
dictionaries have not seen, and so is the size of the dictionaries of passages.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lanespan.llm.common import text_bytes
from lanespan.llm.labelled import fold, sample

#: Bytes of a window and of the way to the next one; windows overlap and cover the whole text.
WINDOW, STEP = 64, 48
SHARED, PECULIAR = 6144, 4096
#: Bound of the sample: documents of a class. Half of them make the dictionaries, half calibrate.
PER_CLASS = 1500
#: Bytes of a gram, slots that grams are counted in by hash, and bytes of the passages' dictionary to choose from by calibration.
GRAM, SLOTS, TRAINED = 8, 1 << 24, (512, 1024, 4096)
#: Parts of the calibration documents for that choice.
TURNS = 5
#: A word or gram is peculiar to a class when its share of documents there is so many times the other's, with so large a chi-square.
TIMES, CHI_SQUARE, LEAST = 3.0, 20.0, 5
#: Thresholds on the bytes saved, to choose from by calibration.
SAVED = ((2, 3, 4, 6), (1, 2, 3, 4), (3, 5, 8, 12))
THRESHOLD = 0.5
FOLDS, HELD = 5, 0
WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


@functools.lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(
        window_log=15,
        chain_log=15,
        hash_log=15,
        search_log=4,
        min_match=5,
        target_length=16,
        strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
    )
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how)


def _features(saved: np.ndarray, thresholds: tuple[int, ...]) -> np.ndarray:
    top = np.sort(saved)[-3:]
    shares = [(saved >= s).mean() for s in thresholds]
    counts = [np.log1p((saved >= s).sum()) for s in thresholds]
    return np.array([top[-1], top.mean(), *np.sqrt(shares), *counts, np.log(len(saved))])


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    shift: float
    saved: tuple[int, ...] = SAVED[0]

    def savings(self, text: bytes) -> np.ndarray:
        """Bytes each window of a text is shorter with the toxic dictionary."""
        low = text.lower()
        windows = [low[k : k + WINDOW] for k in range(0, max(1, len(low) - (WINDOW - STEP)), STEP)]
        a, b = _compressor(self.toxic).compress, _compressor(self.ordinary).compress
        return np.array([len(b(w)) - len(a(w)) for w in windows], np.float64)

    def features(self, text: bytes) -> np.ndarray:
        return _features(self.savings(text), self.saved)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights + self.shift, -30, 30))))


def _frequencies(texts: list[bytes]) -> Counter[bytes]:
    counts: Counter[bytes] = Counter()
    for text in texts:
        counts.update(set(WORD.findall(text.lower())))
    return counts


def _chi_square(own, other, n_own: int, n_other: int):
    """Chi-square of what is in ``own`` documents of a class and ``other`` of the other; zero if it is not peculiar to the class."""
    p, q = (own + 0.5) / (n_own + 1), (other + 0.5) / (n_other + 1)
    mean = (p * n_own + q * n_other) / (n_own + n_other)
    chi = (p - q) ** 2 / (mean * (1 - mean) * (1 / n_own + 1 / n_other))
    return np.where((own >= LEAST) & (p >= TIMES * q) & (chi >= CHI_SQUARE), chi, 0.0)


def _peculiar(own: Counter[bytes], other: Counter[bytes], n_own: int, n_other: int) -> list[bytes]:
    """Words peculiar to a class, the most telling last."""
    found = ((float(_chi_square(k, other[word], n_own, n_other)), word) for word, k in own.items() if k >= LEAST)
    return [word for _, word in sorted(pair for pair in found if pair[0])]


def _grams(low: bytes) -> np.ndarray:
    """Slot of the gram at each byte of a text; none over its end."""
    data = np.frombuffer(low, np.uint8)
    n = max(0, len(data) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for j in range(GRAM):
        out = (out << np.uint64(8)) | data[j : j + n]
    return ((out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)


def _gram_counts(texts: list[bytes]) -> np.ndarray:
    counts = np.zeros(SLOTS, np.int32)
    for text in texts:
        counts[np.unique(_grams(text.lower()))] += 1
    return counts


def _passages(texts: list[bytes], telling: np.ndarray) -> list[bytes]:
    """The stretches of each text that its telling grams cover; texts without any are left out."""
    out = []
    for text in texts:
        low = text.lower()
        at = np.flatnonzero(telling[_grams(low)])
        if len(at):
            cover = np.zeros(len(low) + 2, np.int64)
            np.add.at(cover, at + 1, 1)
            np.add.at(cover, at + 1 + GRAM, -1)
            ends = np.flatnonzero(np.diff((np.cumsum(cover) > 0).astype(np.int8)))
            out.append(b" ".join(low[i:j] for i, j in zip(ends[::2], ends[1::2], strict=True)))
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples; of too few samples they themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _trained(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of windows spread over the texts; of too few windows the windows themselves."""
    return _dictionary([t.lower()[k : k + WINDOW] for t in texts for k in range(0, len(t), max(WINDOW, len(t) // 20))], size)


def _regression(z: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> np.ndarray:
    """Weights of a logistic regression; the last column of ``z`` is constant."""
    w = np.zeros(z.shape[1])
    w[-1] = prior
    ridge = np.r_[np.ones(len(w) - 1), 0.0]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + ridge * w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6)
        w -= np.linalg.solve(bend, slope)
    return w


def _unseen_loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> float:
    """Logistic loss of each part of the documents under a regression on the other parts."""
    total, turn = 0.0, np.arange(len(y)) % TURNS
    for k in range(TURNS):
        out = turn == k
        if out.any() and len(set(y[~out])) == 2:
            w = _regression(z[~out], y[~out], weight[~out], prior)
            total += float((weight[out] * np.logaddexp(0, np.where(y[out] == 1, -1, 1) * (z[out] @ w))).sum())
    return total


def train(rows: list[tuple[bytes, int]], counts: dict[int, int]) -> Model:
    """Fit dictionaries and calibration; classes are weighted back to their shares among all labelled documents."""
    prior = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    size = len(SAVED[0]) * 2 + 3
    made = {y: [t for t, label in rows if label == y][::2] for y in (0, 1)}
    rest = [(t, y) for y in (0, 1) for t, label in [r for r in rows if r[1] == y][1::2]]
    model = Model(b" ", b" ", np.zeros(size), prior)
    if not made[0] or not made[1] or len({y for _, y in rest}) < 2:
        return model
    n = {label: len(texts) for label, texts in made.items()}
    freq = {label: _frequencies(texts) for label, texts in made.items()}
    grams = {label: _gram_counts(texts) for label, texts in made.items()}
    words, passages = {}, {}
    for own, other in ((0, 1), (1, 0)):
        words[own] = b" " + b" ".join(_peculiar(freq[own], freq[other], n[own], n[other]))[-PECULIAR:] + b" "
        often = np.flatnonzero(grams[own] >= LEAST)
        telling = np.zeros(SLOTS, bool)
        telling[often] = _chi_square(grams[own][often], grams[other][often], n[own], n[other]) > 0
        passages[own] = _passages(made[own], telling)
    # Trained on ordinary text alone: what marks toxic text is frequent there and would enter both dictionaries.
    shared = _trained(made[0], SHARED)
    filling = _trained(made[0][1::2] or made[0], PECULIAR + max(TRAINED))
    y = np.array([label for _, label in rest], np.float64)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    least = np.inf
    for trained in TRAINED:
        parts = [_dictionary(passages[k], trained) + words[k] for k in (1, 0)]
        # Both are equally long, so that neither finds more by mere size.
        length = max(map(len, parts))
        toxic, ordinary = (shared + (filling + part)[-length:] for part in parts)
        tried = Model(toxic, ordinary, np.zeros(size), prior)
        savings = [tried.savings(t) for t, _ in rest]
        for thresholds in SAVED:
            x = np.array([_features(saved, thresholds) for saved in savings])
            mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
            z = np.c_[(x - mean) / spread, np.ones(len(x))]
            loss = _unseen_loss(z, y, weight, prior)
            if loss < least:
                least, w = loss, _regression(z, y, weight, prior)
                model = Model(toxic, ordinary, w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum()), thresholds)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    rows, counts = sample(docs, labels, label, FOLDS, HELD, PER_CLASS)
    return train(rows, counts)


def score(model: Model) -> Column:
    """Score of the column ``text``, whole; null counts as empty."""

    @arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array([model.score(t.as_py()) for t in column], pa.float64())

    return run(text_bytes())


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts are scored alike. A null ``doc_id`` is not held out. Without labels of both classes every score is the
    smoothed share of class 1. Repeated rows have repeated results.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), score(fit(docs, labels)).alias("score"))
    held = F.coalesce(fold(FOLDS) == HELD, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
