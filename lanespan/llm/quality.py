"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector; learned filters run over every fourth position of the whole document; their responses are
max-pooled inside overlapping chunks, the chunks' maxima are averaged, and one logistic unit turns them into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lanespan.llm.common import free_name, slices, text_bytes
from lanespan.llm.labelled import fold, sample

DEPTH, WIDTH, STRIDE, FILTERS = 4, 12, 4, 24
#: A chunk is four blocks of bytes and begins every third block, so neighbours share a block.
BLOCK, CHUNK, STEP = 256, 4, 3
#: Bound of the sample: documents of a class, and blocks of one document (spread evenly over it) that a fit reads.
PER_CLASS, FIT_CHUNKS = 1200, 8
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.01, 7
#: Bytes of the pieces of good documents that are learned as well, and their weight.
SHORT, SHORT_WEIGHT = (20, 200), 0.3
THRESHOLD = 0.3
SLICE = 1 << 20
FOLDS, HELD = 5, 0


@dataclass
class Network:
    bytes_: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each document; an empty one is a document of padding."""
        blocks, first = _blocks(data, offsets)
        maxima = self.block_maxima(blocks, first[1:] - 1)
        chunk, owner = _chunks(first)
        pooled = np.maximum.reduceat(maxima[chunk.ravel()], np.arange(0, chunk.size, CHUNK))
        n = np.bincount(owner, minlength=len(offsets) - 1)
        mean = np.add.reduceat(pooled, np.r_[0, np.cumsum(n)[:-1]]) / n[:, None]
        # Sums go along a document's own row: a product over all documents may round one of them by where it stands.
        return 1 / (1 + np.exp(-np.clip((mean * self.out).sum(axis=1) + self.shift, -30, 30)))

    def block_maxima(self, blocks: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each block; windows at a block's end reach into the next one, but not over a document's ``last``."""
        spread = self.bytes_[blocks]
        positions = (len(blocks) - (WIDTH - STRIDE)) // STRIDE
        item = spread.itemsize * DEPTH
        views = np.lib.stride_tricks.as_strided(spread, (positions, WIDTH * DEPTH), (item * STRIDE, spread.itemsize))
        # One product of the same shape per block, so that a block's responses do not depend on its neighbours.
        response = np.ascontiguousarray(views).reshape(-1, BLOCK // STRIDE, WIDTH * DEPTH) @ self.filters
        response[last, 1 - WIDTH // STRIDE :] = -np.inf
        return np.maximum(response.max(axis=1) + self.bias, 0)


def _blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another, each filled with zero bytes to whole blocks (and by a filter's width at least)."""
    lengths = np.diff(offsets)
    counts = (lengths + WIDTH + BLOCK - 1) // BLOCK
    first = np.r_[0, np.cumsum(counts)]
    out = np.zeros(first[-1] * BLOCK + WIDTH - STRIDE, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], lengths)] = data
    return out, first


def _chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each chunk, and the document it belongs to; a short last chunk repeats its last block."""
    counts = np.diff(first)
    chunks = 1 + np.maximum(0, -(-(counts - CHUNK) // STEP))
    owner = np.repeat(np.arange(len(counts)), chunks)
    k = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    blocks = first[owner][:, None] + k[:, None] * STEP + np.arange(CHUNK)
    return np.minimum(blocks, first[owner + 1][:, None] - 1), owner


def train(rows: list[tuple[bytes, int]], counts: dict[int, int]) -> Network:
    """Fit by Adam on the sample; classes are weighted back to their shares among all labelled documents."""
    rng = np.random.default_rng(SEED)
    net = Network(
        rng.normal(0, 0.3, (256, DEPTH)).astype(np.float32),
        rng.normal(0, 0.15, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, FILTERS).astype(np.float32),
        0.0,
    )
    net.bytes_[0] = 0
    y = np.array([label for _, label in rows], np.float32)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(set(y.tolist())) < 2:
        net.out[:] = 0
        net.shift = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
        return net
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
    # Good text is good in small pieces too; without these, what is short looks odd by its padding alone.
    short = [text[k : k + size] for text, label in rows if label for size in [int(rng.integers(*SHORT))] for k in [int(rng.integers(0, max(1, len(text) - size)))]]
    texts = [text for text, _ in rows] + short
    y, weight = np.r_[y, np.ones(len(short), np.float32)], np.r_[weight, np.full(len(short), SHORT_WEIGHT * weight[y == 1].mean(), np.float32)]
    parts = []
    for text in texts:
        block, first = _blocks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        chunk, _ = _chunks(first)
        chosen = chunk[np.unique(np.linspace(0, len(chunk) - 1, FIT_CHUNKS).astype(int))]
        reach = np.arange(BLOCK * CHUNK + WIDTH - STRIDE)
        parts.append(block[np.minimum(chosen[:, :1] * BLOCK + reach, len(block) - 1)])
    shapes = [net.bytes_, net.filters, net.bias, net.out, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in shapes]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            batch = order[lo : lo + BATCH]
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for p, (m, v), g in zip(shapes, moments, _gradients(net, float(shapes[4][0]), [parts[i] for i in batch], y[batch], weight[batch]), strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            net.bytes_[0] = 0
    net.shift = float(shapes[4][0])
    return net


def _gradients(net: Network, shift: float, parts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    chunks = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    n = np.bincount(owner)
    spread = net.bytes_[chunks]
    windows = np.lib.stride_tricks.sliding_window_view(spread, WIDTH, axis=1)[:, ::STRIDE].swapaxes(2, 3)
    windows = np.ascontiguousarray(windows).reshape(len(chunks), -1, WIDTH * DEPTH)
    response = windows @ net.filters
    best = response.argmax(axis=1)
    pooled = np.take_along_axis(response, best[:, None], axis=1)[:, 0] + net.bias
    active = np.maximum(pooled, 0)
    mean = np.add.reduceat(active, np.r_[0, np.cumsum(n)[:-1]]) / n[:, None]
    p = 1 / (1 + np.exp(-np.clip(mean @ net.out + shift, -30, 30)))
    d = ((p - y) * weight / len(parts)).astype(np.float32)
    back = (d / n)[owner][:, None] * net.out * (pooled > 0)
    chosen = np.take_along_axis(windows, best[:, :, None], axis=1)  # chunk x filter x window
    filters = np.einsum("cf,cfw->wf", back, chosen)
    into = (back[:, :, None] * net.filters.T).reshape(len(chunks), FILTERS, WIDTH, DEPTH)
    where = best[:, :, None] * STRIDE + np.arange(WIDTH)
    bytes_ = np.zeros_like(net.bytes_)
    np.add.at(bytes_, chunks[np.arange(len(chunks))[:, None, None], where], into)
    return [bytes_, filters, back.sum(axis=0), mean.T @ d, np.array([d.sum()], np.float32)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    rows, counts = sample(docs, labels, label, FOLDS, HELD, PER_CLASS)
    return train(rows, counts)


def score(net: Network) -> Column:
    """Score of the column ``text``, whole; null counts as empty."""

    @arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [net.scores(data, offsets) for _, _, data, offsets in slices(column, SLICE)]
            yield pa.array(np.concatenate(parts).astype(np.float64) if parts else np.zeros(0))

    return run(text_bytes())


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts are scored alike. A null ``doc_id`` is not held out. Without labels of both classes every
    score is the smoothed share of class 1. Repeated rows have repeated results.
    """
    net = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), score(net).alias("score"))
    held = F.coalesce(fold(FOLDS) == HELD, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    name = free_name(docs, "score")
    scored = docs.select("*", score(fit(docs, labels)).alias(name))
    return scored.filter(F.col(name) >= THRESHOLD).drop(name)
