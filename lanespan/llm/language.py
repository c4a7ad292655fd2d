"""Language identification of mixed text.

Every word gets a score per language from the three-byte runs it is made of. The ranges of its characters' script leave only the
languages that use that script as candidates. A Viterbi pass over the words, with a penalty for each switch, labels
spans; the language with most bytes is the document's.

The pass runs over pieces of many documents at once: a piece keeps, for each language it may be entered in, the best way through;
the pieces of a document are then chained and traced back. The result equals one pass from word to word, which is
what many languages get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lanespan.llm.common import slices, text_bytes
from lanespan.llm.labelled import bounded, fold

#: Bound of the sample: documents of a language, and bytes of one document that are counted (spread evenly over it).
PER_LANGUAGE, FIT_BYTES = 400, 1 << 16
PARTS = 256
BINS = 1 << 16
PENALTY = 6.0
#: Words of a piece, and bytes of text handled at a time.
PIECE, SLICE = 128, 2 << 20
#: Languages beyond which pieces, which hold a way from each label to each, would take too much memory.
MANY = 32
#: A language uses a script when so large a share of its words has it.
USES = 0.01
FOLDS, HELD = 4, 2
UNKNOWN = "und"
#: First code points of script ranges, and the script that begins there (0: none of its own).
SCRIPTS = [
    (0x0000, 1), (0x0300, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0900, 7), (0x0980, 8), (0x0A00, 9),
    (0x0A80, 10), (0x0B00, 11), (0x0B80, 12), (0x0C00, 13), (0x0C80, 14), (0x0D00, 15), (0x0D80, 16), (0x0E00, 17), (0x0E80, 18),
    (0x0F00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x13A0, 0), (0x1780, 24), (0x1800, 25), (0x18B0, 0),
    (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 26), (0x3100, 0), (0x3130, 22), (0x3190, 0), (0x3400, 27), (0xA000, 0),
    (0xAC00, 22), (0xD7B0, 0), (0xF900, 27), (0xFB00, 0), (0x20000, 27),
]
SCRIPT_STARTS = np.array([a for a, _ in SCRIPTS])
SCRIPT_OF = np.array([b for _, b in SCRIPTS])
N_SCRIPTS = int(SCRIPT_OF.max()) + 1


def _alphabet() -> np.ndarray:
    """Bytes as the model sees them: A-Z lower-cased, all but letters and bytes of longer characters blank."""
    table = np.full(256, 0x20, np.uint8)
    for b in range(256):
        if 0x61 <= b <= 0x7A or b >= 0x80:
            table[b] = b
        elif 0x41 <= b <= 0x5A:
            table[b] = b + 32
    return table


ALPHABET = _alphabet()


@dataclass
class Parsed:
    """Words of some texts: where they begin and end in the bytes, the first word of each text, a bin for each byte, scripts."""

    starts: np.ndarray
    ends: np.ndarray
    of_text: np.ndarray
    bins: np.ndarray
    scripts: np.ndarray


def parse(data: np.ndarray, offsets: np.ndarray) -> Parsed:
    seen = ALPHABET[data]
    inside = seen != 0x20
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = inside & (np.r_[True, ~inside[:-1]] | edge[:-1]) if len(data) else inside
    closes = inside & (np.r_[~inside[1:], True] | edge[1:]) if len(data) else inside
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    left = np.r_[np.uint8(0x20), seen[:-1]] if len(seen) else seen
    right = np.r_[seen[1:], np.uint8(0x20)] if len(seen) else seen
    left, right = np.where(opens, np.uint8(0x20), left), np.where(closes, np.uint8(0x20), right)
    run = left.astype(np.uint32) << 16 | seen.astype(np.uint32) << 8 | right
    bins = (run * np.uint32(0x9E3779B1)) >> np.uint32(16)
    scripts = np.full(len(starts), 1)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        wide = np.r_[data, np.zeros(3, np.uint8)].astype(np.int64)
        b, c, d, e = wide[lead], wide[lead + 1] & 63, wide[lead + 2] & 63, wide[lead + 3] & 63
        code = np.where(b < 0xE0, (b & 31) << 6 | c, np.where(b < 0xF0, (b & 15) << 12 | c << 6 | d, (b & 7) << 18 | c << 12 | d << 6 | e))
        script = SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, code, "right") - 1]
        word = np.searchsorted(starts, lead, "right") - 1
        np.maximum.at(scripts, word[script > 1], script[script > 1])
    return Parsed(starts, ends, np.searchsorted(starts, offsets), bins, scripts)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bins x languages, log-probabilities
    uses: np.ndarray  # scripts x languages

    def label(self, p: Parsed) -> np.ndarray:
        """Language of each word."""
        if not len(p.starts):
            return np.zeros(0, np.int64)
        # Bytes between words count nothing: sums run from a word's start to its end.
        steps = np.c_[p.starts, p.ends].ravel()
        gathered = np.vstack([self.table[p.bins], np.zeros((1, len(self.languages)), np.float32)])
        scores = np.add.reduceat(gathered, steps, axis=0)[::2].astype(np.float64)
        allowed = self.uses[p.scripts]
        scores = np.where(allowed | ~allowed.any(axis=1, keepdims=True), scores, -1e6)
        return viterbi(scores, p.of_text)


def viterbi(scores: np.ndarray, of_text: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of each word, per text, where every change of label costs ``penalty``."""
    k = scores.shape[1]
    if k > MANY:
        return _word_by_word(scores, of_text, penalty)
    counts = np.diff(of_text)
    pieces = -(-counts // PIECE)
    text = np.repeat(np.arange(len(counts)), pieces)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = of_text[text] + turn * PIECE
    length = np.minimum(PIECE, of_text[text + 1] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    n = len(begin)
    # best[piece, label entered from, label]; back[step, piece, label entered from, label]
    best = scores[begin][:, None, :] - penalty * (1 - np.eye(k))
    back = np.zeros((PIECE, n, k, k), np.int8)
    active = np.searchsorted(-length, -np.arange(PIECE), "left")  # pieces longer than each step
    for t in range(1, PIECE):
        m = int(active[t])
        if not m:
            break
        now = best[:m]
        top = now.argmax(axis=2)
        switch = np.take_along_axis(now, top[:, :, None], axis=2) - penalty
        stay = now >= switch
        back[t, :m] = np.where(stay, np.arange(k), top[:, :, None])
        best[:m] = np.where(stay, now, switch) + scores[begin[:m] + t][:, None, :]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    first = np.cumsum(pieces) - pieces
    state = np.zeros((len(counts), k))
    came = np.zeros((n, k), np.int8)
    for j in range(int(pieces.max(initial=0))):
        has = np.flatnonzero(pieces > j)
        at = place[first[has] + j]
        total = state[has][:, :, None] + best[at]
        came[at] = total.argmax(axis=1)
        state[has] = total.max(axis=1)
    out_state = np.zeros(n, np.int64)
    in_state = np.zeros(n, np.int64)
    current = state.argmax(axis=1)
    for j in range(int(pieces.max(initial=0)) - 1, -1, -1):
        has = np.flatnonzero(pieces > j)
        at = place[first[has] + j]
        out_state[at] = current[has]
        current[has] = in_state[at] = came[at, current[has]]
    labels = np.zeros(len(scores), np.int64)
    state = out_state
    for t in range(PIECE - 1, -1, -1):
        m = int(active[t])
        labels[begin[:m] + t] = state[:m]
        if t:
            state[:m] = back[t, np.arange(m), in_state[:m], state[:m]]
    return labels


def _word_by_word(scores: np.ndarray, of_text: np.ndarray, penalty: float) -> np.ndarray:
    """As :func:`viterbi`, in one pass over all texts side by side; memory grows with words times labels only."""
    k, counts = scores.shape[1], np.diff(of_text)
    order = np.argsort(-counts, kind="stable")
    begin, counts = of_text[:-1][order], counts[order]
    back = np.zeros((len(scores), k), np.min_scalar_type(k))
    best = np.zeros((len(begin), k))
    active = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), "left")
    for t, m in enumerate(active.tolist()):
        at, now = begin[:m] + t, best[:m]
        if t:
            top = now.argmax(axis=1)[:, None]
            switch = np.take_along_axis(now, top, axis=1) - penalty
            stay = now >= switch
            back[at] = np.where(stay, np.arange(k), top)
            now = np.where(stay, now, switch)
        best[:m] = now + scores[at]
    labels, state = np.zeros(len(scores), np.int64), best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        at = begin[: active[t]] + t
        labels[at] = state[: active[t]]
        state[: active[t]] = back[at, state[: active[t]]]
    return labels


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def train(rows: list[tuple[bytes, str]]) -> Model:
    languages = sorted({lang for _, lang in rows})
    counts = np.zeros((BINS, max(1, len(languages))))
    words = np.zeros((N_SCRIPTS, max(1, len(languages))))
    for text, lang in rows:
        k = languages.index(lang)
        raw = text
        if len(text) > FIT_BYTES:
            step = len(text) // 16
            raw = b" ".join(text[i : i + FIT_BYTES // 16] for i in range(0, len(text), step))
        p = parse(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        np.add.at(counts[:, k], p.bins[ALPHABET[np.frombuffer(raw, np.uint8)] != 0x20], 1)
        np.add.at(words[:, k], p.scripts, 1)
    table = np.log((counts + 0.2) / (counts.sum(axis=0) + 0.2 * BINS)).astype(np.float32)
    return Model(languages, table, words >= USES * np.maximum(1, words.sum(axis=0)))


def fit(docs: DataFrame) -> Model:
    """Learn from a bounded sample of each language: the first documents in the order of a hash of ``doc_id``."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(FOLDS) != HELD))
    ids = known.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    ids = ids.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    # First of each part, so that no task ranks more than a fixed number of a language's documents.
    for keys in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id"))
        ids = ids.withColumn("rank", rank).filter(F.col("rank") <= PER_LANGUAGE)
    chosen = ids.select("doc_id", "lang").distinct()
    texts = known.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_bytes().alias("text"))
    texts = texts.withColumn("text", bounded(F.col("text")))
    # One text of each chosen id and language, however many rows share them.
    rows = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return train(sorted((bytes(r.text), r.lang) for r in rows))


def predict(model: Model, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[str, float, list[dict]]]:
    """Language, share of its bytes among all bytes of words, and the spans of each text."""
    p = parse(data, offsets)
    labels = model.label(p) if model.languages else np.zeros(len(p.starts), np.int64)
    sizes = p.ends - p.starts
    letters = (data >= 0x41) & (data <= 0x5A) | (data >= 0x61) & (data <= 0x7A)
    count = np.r_[0, np.cumsum(letters)][offsets]
    change = np.r_[True, labels[1:] != labels[:-1]] if len(labels) else np.zeros(0, bool)
    for k, (a, b) in enumerate(zip(p.of_text[:-1].tolist(), p.of_text[1:].tolist(), strict=True)):
        lo, hi = int(offsets[k]), int(offsets[k + 1])
        sure = count[k + 1] > count[k] or has_letter(data[lo:hi].tobytes())
        if not sure or a == b or not model.languages:
            yield UNKNOWN, 0.0, []
            continue
        weight = np.bincount(labels[a:b], weights=sizes[a:b], minlength=len(model.languages))
        top = int(weight.argmax())
        begins = np.unique(np.r_[a, a + np.flatnonzero(change[a:b])])
        lasts = np.r_[begins[1:], b] - 1
        spans = [
            {"begin": int(p.starts[i]) - lo, "end": int(p.ends[j]) - lo, "lang": model.languages[labels[i]]}
            for i, j in zip(begins.tolist(), lasts.tolist(), strict=True)
        ]
        yield model.languages[top], float(weight[top] / weight.sum()), spans


SPANS = "array<struct<begin:bigint,end:bigint,lang:string>>"


def detect(model: Model) -> Column:
    """``lang_pred, score, spans`` of the column ``text``, whole; span ends are byte offsets in the text."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])

    @arrow_udf(f"lang_pred string, score double, spans {SPANS}")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            found = [
                {"lang_pred": lang, "score": score, "spans": spans}
                for _, _, data, offsets in slices(column, SLICE)
                for lang, score, spans in predict(model, data, offsets)
            ]
            yield pa.array(found, kind)

    return run(text_bytes())


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` of every row.

    ``und`` with score 0 and no spans: null or empty text, text without a letter, or no labelled document to learn from. A null ``doc_id`` is not
    held out. ``score`` is the share of the language among the bytes of words. Ties go to the first language by name.
    """
    found = detect(model or fit(docs)).alias("found")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), found)
    held = F.coalesce(fold(FOLDS) == HELD, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held, "found.lang_pred", "found.score", "found.spans")
