"""Language identification with error-correcting output codes.

Every language has a codeword of -1/+1 bits.  One binary n-gram classifier per
bit predicts its value from the text: hashed byte n-grams of lengths 1 to 3 over
lower-cased letters, weighted by the log odds of the two sides of the bit and
calibrated by a logistic fit.  Decoding is loss-weighted: a language's distance
is the sum over bits of logistic loss times that bit's reliability for the
language, and the nearest codeword wins.  A prediction is ambiguous when the gap
to the second nearest is below a threshold taken from the training rows.

Codes: all ``2^(K-1) - 1`` different bits for up to seven languages, otherwise
the dense random code with the largest minimum distance out of a fixed series.

The classifiers are fitted on a bounded, documented sample (``TRAIN_ROWS`` rows,
shared between the languages, chosen by a hash of the id); prediction reads every
whole text in one scan without a shuffle.

Cases: a null text or one without a letter is ``und`` with score 0, ambiguous;
with no labelled row every text is ``und``; with one language that language is
predicted; very long texts are counted in pieces; rows are independent, so
repeated rows and ids get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, small_batches, tidy

TRAIN_ROWS = 6_000
BUCKETS = 2_048          # hashed n-grams per length
LENGTHS = (1, 2, 3)
PIECE = 500_000          # characters counted at once
UNKNOWN = "und"
AMBIGUOUS_SHARE = 0.001  # share of correct training rows that may count as ambiguous
LETTER = re.compile(r"[^\W\d_]")

# Bytes of letters: a-z as they are, A-Z lower-cased, the bytes of non-ASCII
# characters as they are; everything else is one separator.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(texts: list[str]) -> np.ndarray:
    """Share of every hashed n-gram among a text's n-grams of that length:
    (texts, lengths * BUCKETS)."""
    out = np.zeros((len(texts), len(LENGTHS) * BUCKETS), np.float32)
    for start, end in slices(texts, PIECE):
        rows = end - start
        counts = np.zeros((len(LENGTHS), rows * BUCKETS), np.float32)
        joined = [t.encode() for t in texts[start:end]]
        # A text and its separators: whatever text comes next begins with two, so
        # no gram holds letters of two texts.
        size = np.array([len(b) + 3 for b in joined])
        data = _FOLD[np.frombuffer(b"".join([*(b"  " + b + b" " for b in joined), b"  "]), np.uint8)]
        row = np.repeat(np.arange(rows, dtype=np.int64) * BUCKETS, size)
        for at in range(0, len(row), PIECE):
            code = data[at:at + PIECE + 2].astype(np.uint32)
            r = row[at:at + PIECE]
            gram = code.copy()
            for k, n in enumerate(LENGTHS):
                if n > 1:
                    gram = (gram[:-1] << 8) | code[n - 1:]
                bucket = ((gram * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)[:len(r)]
                bucket += r[:len(bucket)]
                counts[k] += np.bincount(bucket, minlength=rows * BUCKETS)
        for k in range(len(LENGTHS)):
            c = counts[k].reshape(rows, BUCKETS)
            # Separators alone say nothing.
            c[:, (int.from_bytes(b" " * LENGTHS[k], "big") * 2654435761 & 0xFFFFFFFF) >> 21] = 0
            c /= np.maximum(c.sum(1, keepdims=True), 1)
            out[start:end, k * BUCKETS:(k + 1) * BUCKETS] = c
    return out


def codewords(k: int) -> np.ndarray:
    """A (k, bits) matrix of -1/+1; every column splits the languages in two."""
    if k <= 7:
        cols = [[1 if (b >> i) & 1 else -1 for i in range(k)] for b in range(1, 2 ** k - 1) if b & 1]
        return np.array(cols, np.int8).reshape(-1, k).T
    bits = 8 * int(np.ceil(np.log2(k)))
    best, far = None, -1
    for seed in range(50):
        m = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (k, bits))
        m = m[:, np.abs(m.sum(0)) < k]  # a column of one value tells nothing
        d = (m.shape[1] - m.astype(int) @ m.T.astype(int)) // 2
        gap = d[~np.eye(k, dtype=bool)].min()
        if gap > far:
            best, far = m, gap
    return best


class Model:
    """The fitted classifiers: plain arrays, sent to tasks as one closure value."""

    def __init__(self, languages, code, weights, scale, shift, trust, gap):
        self.languages, self.code, self.weights = languages, code, weights
        self.scale, self.shift, self.trust, self.gap = scale, shift, trust, gap

    def margins(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights) * self.scale + self.shift

    def distances(self, margins: np.ndarray) -> np.ndarray:
        """(texts, languages): reliability-weighted logistic loss to each codeword."""
        loss_pos, loss_neg = np.logaddexp(0, -margins), np.logaddexp(0, margins)
        plus = self.trust * (self.code > 0)
        return loss_pos @ plus.T + loss_neg @ (self.trust - plus).T

    def decode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) per text that has a letter."""
        if not texts or not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if len(self.languages) == 1:
            return self.languages * len(texts), np.ones(len(texts)), np.zeros(len(texts), bool)
        d = self.distances(self.margins(features(texts)))
        near = d.argmin(1)
        e = np.exp(d.min(1, keepdims=True) - d)
        two = np.partition(d, 1, axis=1)
        return ([self.languages[i] for i in near], 1.0 / e.sum(1), two[:, 1] - two[:, 0] < self.gap)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    """Fit one classifier per code bit on feature rows ``x`` and labels ``y``."""
    k = len(languages)
    if k < 2:
        return Model(languages, None, None, None, None, None, 0.0)
    code = codewords(k)
    share = np.stack([x[y == i].mean(0) if (y == i).any() else np.zeros(x.shape[1]) for i in range(k)])
    weights, scale, shift = [], [], []
    floor = 1e-5
    for b in range(code.shape[1]):
        pos, neg = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
        w = np.log((pos + floor) / (neg + floor))
        f, t = x @ w, (code[y, b] > 0).astype(float)
        a, c = 1.0 / max(f.std(), 1e-9), 0.0
        for _ in range(30):  # Newton steps of a ridge-damped logistic fit
            p = 1 / (1 + np.exp(-np.clip(a * f + c, -30, 30)))
            h = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - t) * f).sum() + 1e-2 * a, (p - t).sum()])
            hess = np.array([[(h * f * f).sum() + 1e-2, (h * f).sum()], [(h * f).sum(), h.sum() + 1e-2]])
            step = np.linalg.solve(hess, g)
            a, c = a - step[0], c - step[1]
            if np.abs(step).max() < 1e-6:
                break
        weights.append(w)
        scale.append(a)
        shift.append(c)
    m = Model(languages, code, np.stack(weights, 1).astype(np.float32), np.array(scale), np.array(shift),
              np.ones(code.shape) / code.shape[1], 0.0)
    right = (m.margins(x) > 0) == (code[y] > 0)
    trust = np.stack([right[y == i].mean(0) if (y == i).any() else np.ones(code.shape[1]) for i in range(k)])
    m.trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-9)
    d = np.sort(m.distances(m.margins(x)), 1)
    good = m.distances(m.margins(x)).argmin(1) == y
    if good.any():
        m.gap = float(np.quantile((d[:, 1] - d[:, 0])[good], AMBIGUOUS_SHARE))
    return m


def held_out(id_col: str) -> Column:
    """The rows that never take part in training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` rows of ``labelled``, the same number per language
    where there are enough.  The feature rows of this bounded sample are made on
    the executors and are all that reaches the driver (half precision)."""
    labelled = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = sorted((r[0], r[1]) for r in labelled.groupBy(lang_col).count().collect())
    languages = [c[0] for c in counts]
    if len(languages) < 2:
        return fit(np.zeros((0, 1)), np.zeros(0, int), languages)
    per = rows / len(languages)
    share = F.create_map(*[v for lang, n in counts for v in (F.lit(lang), F.lit(min(1.0, per / n)))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("train")), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.where(draw < share[F.col(lang_col)]).select(F.col(text_col).alias("t"),
                                                                  F.col(lang_col).alias("l"))
    small_batches(labelled.sparkSession)

    def run(batches):
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            x = features(texts).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array([r.tobytes() for r in x], pa.binary())],
                                             ["l", "x"])

    got = sorted((r.l, bytes(r.x)) for r in chosen.mapInArrow(tidy(run), "l string, x binary").toLocalIterator())
    x = np.frombuffer(b"".join(g[1] for g in got), np.float16).reshape(len(got), -1).astype(np.float32)
    y = np.array([languages.index(g[0]) for g in got], int)
    return fit(x, y, languages)


def predict(docs: DataFrame, model: Model, text_col: str = "text",
            names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``docs`` plus the language, its score and whether it is ambiguous (existing
    columns of these names are replaced).  The text alone decides."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*names)
    schema = docs.withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0), names[2]: F.lit(True)}).schema
    columns, place = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(place).to_pylist()
            told = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
            lang, score, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            for i, l, s, u in zip(told, *model.decode([texts[i] for i in told])):
                lang[i], score[i], unsure[i] = l, float(s), bool(u)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                [*columns, *names])

    return docs.mapInArrow(tidy(run), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) for every row of ``docs``."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    text = free_name(docs.select(id_col), "_text")
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias(text))
    return predict(rows, model, text).drop(text)
