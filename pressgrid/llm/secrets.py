"""Secret scanning: fixed rules plus a small character convolutional network.

Base findings, leftmost non-overlapping per kind, positions in code points,
end exclusive:

* ``assign``: a password-like name, an equals sign or colon, and a value of 12
  or more characters;
* ``access``: ``AKIA`` and letters or digits, 18 or more in all;
* ``hex``: 16 or more lowercase hexadecimal digits.

Base findings always stay.  A wider generator proposes further candidates
(long mixed tokens and values of ``MIN_PART`` or more characters after the base
rule's names and after words such as ``key`` or ``auth``; without the parts that are
base findings).  Every
candidate, base ones included, is scored with its surrounding context by a
convolutional network in numpy; a candidate that overlaps no base finding
becomes a finding of kind ``model`` when its calibrated probability reaches the
threshold.  Candidates may overlap: a long token, its pieces between separators, a
named value.  One longer than ``VALUE`` is scored in overlapping stretches, and the
stretches that pass are what is found; of overlapping ones the most probable stays.  The network is trained on labelled findings: base findings are
positive, other candidates and ordinary words negative, except that short values
after a base rule's name and separator are neither; half of the named
positives (by their value's hash) are shown without their name, so that the value
itself is learned.

The network is fitted on a bounded sample (``TRAIN_DOCS`` documents chosen by a
hash, ``TRAIN_CASES`` windows a class).  Its probabilities and the threshold come from
all documents: every labelled candidate, base ones included, is scored, and the counts
per score bin and label are added up in Spark (see ``score_counts``).  The threshold
always keeps the wanted recall on them: of those with as few false findings as the
highest such threshold, the one nearest to one half, which may lie below it.
Calibration and scan each read every whole text in one pass; only counts are shuffled.

Cases: a null text counts as empty and has no finding; very long texts are
scanned whole; without positive cases the network adds nothing; rows are
independent, so repeated rows get equal results; an empty table gives an empty
result; other columns pass through (existing output names are replaced).
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, tidy

KINDS = ("assign", "access", "hex")
MODEL_KIND = "model"
TRAIN_DOCS = 20_000
TRAIN_CASES = 1_500
CONTEXT = 24      # characters on either side of a candidate
VALUE = 48        # a longer candidate is scored stretch by stretch
BINS = 64         # score bins per unit of the logit, from -SPAN to SPAN
SPAN = 32
CHARS = 1 << 20   # characters whose candidates are scored together
RECALL = 0.98

# The base rules.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

# The wider generator: long tokens, their pieces between separators (a path or a
# query may hold a key), and values after a naming word.
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_PIECES = (re.compile(r"[A-Za-z0-9+_-]{16,}=*"), re.compile(r"[A-Za-z0-9+]{16,}=*"))
MIN_PART = 8      # the shortest named value, and part of a candidate scored by itself
_NAME = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key|(?<![a-z0-9])(?:pwd|pass|auth|bearer|credential|key))\b)"""
                   r"""["']?+\x20*+[:=]?+\x20*+["']?+""")
_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
# Values that the base rule's names give, whatever their length.
_TOLD = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+(?=[A-Za-z0-9+/_.=-])""")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in order of start, then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, disjoint and in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def named_values(text: str) -> list[tuple[int, int]]:
    """The values after naming words.  A name may stand inside an earlier value
    (``auth=key=...``): its value ends where that one ends, and only its first
    VALUE characters are a candidate of their own, since the stretches of the earlier
    one show the others; so the candidates of a text stay linear in its length."""
    out, end = [], 0
    for m in _NAME.finditer(text):
        s, inner = m.end(), m.end() < end
        if not inner:
            run = _VALUE.match(text, s)
            end = run.end() if run else s
        if end - s >= MIN_PART:
            out.append((s, min(end, s + VALUE) if inner else end))
    return out


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Further candidates, without the parts that are base findings; they may overlap
    each other."""
    taken = merged([(s, e) for s, _, e in base])
    found = set(named_values(text))
    for m in _TOKEN.finditer(text):
        found.add(m.span())
        found.update(x.span() for p in _PIECES for x in p.finditer(text, *m.span()))
    return sorted({part for s, e in found for part in outside(s, e, taken)})


def outside(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a span outside the disjoint spans ``taken``, MIN_PART characters or more."""
    out, i = [], max(0, bisect.bisect_left(taken, (start, start)) - 1)
    while i < len(taken) and taken[i][0] < end:
        if taken[i][0] - start >= MIN_PART:
            out.append((start, taken[i][0]))
        start, i = max(start, taken[i][1]), i + 1
    return out + [(start, end)] * (end - start >= MIN_PART)


# -------------------------------------------------------------------- network

# Character classes: digits, letters by case and place in the alphabet (hex
# letters apart), common marks, space, other, padding.
_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-:\"'@ \n"
_PAD, _OTHER = 0, 1
_INDEX = {c: i + 2 for i, c in enumerate(_ALPHABET)}
SYMBOLS = len(_ALPHABET) + 2
WIDTH = CONTEXT * 2 + VALUE
CHANNELS, KERNEL, FILTERS = 8, 5, 24


# Symbols by Latin-1 code; every other character becomes a question mark, which
# is no symbol of its own.
_SYMBOL = np.array([_INDEX.get(chr(i), _OTHER) for i in range(256)], np.uint8)


def window(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of left context, value and right context in fixed places."""
    out = np.zeros(WIDTH, np.uint8)
    left, value, right = text[max(0, start - CONTEXT):start], text[start:min(end, start + VALUE)], text[end:end + CONTEXT]
    for at, part in ((CONTEXT - len(left), left), (CONTEXT, value), (CONTEXT + VALUE, right)):
        out[at:at + len(part)] = _SYMBOL[np.frombuffer(part.encode("latin-1", "replace"), np.uint8)]
    return out


def stretches(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping stretches of VALUE characters, the last one aligned to the end, so
    that none is a remainder and no place is seen only at a stretch's edge."""
    last = max(start, end - VALUE)
    return [(s, min(end, s + VALUE)) for s in (*range(start, last, VALUE // 2), last)]


def windows_of(text: str, start: int, end: int) -> list[np.ndarray]:
    """One window per stretch, so long values count whole."""
    return [window(text, s, e) for s, e in stretches(start, end)]


def unnamed(text: str, name: int, start: int, end: int) -> list[np.ndarray]:
    """The windows of a value as if its name, which begins at ``name``, were not there."""
    before = text[max(0, name - CONTEXT):name]
    return windows_of(before + text[start:end + CONTEXT], len(before), len(before) + end - start)


class Network:
    """Embedding, one convolution, maximum and mean over the value and the
    context, one logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"emb": r.normal(0, 0.3, (SYMBOLS, CHANNELS)),
                  "conv": r.normal(0, 0.2, (KERNEL * CHANNELS, FILTERS)), "cb": np.zeros(FILTERS),
                  "out": r.normal(0, 0.1, 3 * FILTERS), "ob": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        pos = np.arange(WIDTH - KERNEL + 1) + KERNEL // 2
        self.value = (pos >= CONTEXT) & (pos < CONTEXT + VALUE)
        self.scale, self.shift, self.threshold, self.cut = 1.0, 0.0, 2.0, np.inf

    def _forward(self, x: np.ndarray):
        e = self.p["emb"][x]
        cols = np.lib.stride_tricks.sliding_window_view(e, KERNEL, 1).transpose(0, 1, 3, 2)
        cols = cols.reshape(len(x), WIDTH - KERNEL + 1, KERNEL * CHANNELS)
        h = np.maximum(cols @ self.p["conv"] + self.p["cb"], 0)
        v, c = h[:, self.value], h[:, ~self.value]
        f = np.concatenate([v.max(1), v.mean(1), c.max(1)], 1)
        return cols, h, f, f @ self.p["out"] + self.p["ob"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def chance(self, z: np.ndarray) -> np.ndarray:
        """The calibrated probability of logits."""
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.chance(self.logits(x))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 3e-3,
              seed: int = 7) -> None:
        """Adam on the logistic loss."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for idx in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                xb, yb = x[idx], y[idx]
                cols, h, f, z = self._forward(xb)
                d = ((1 / (1 + np.exp(-z)) - yb) / len(idx)).astype(np.float32)
                df = d[:, None] * self.p["out"]
                dh = np.zeros_like(h)
                for part, keep in ((0, self.value), (2, ~self.value)):
                    where = np.flatnonzero(keep)[h[:, keep].argmax(1)]
                    dh[np.arange(len(idx))[:, None], where, np.arange(FILTERS)] += \
                        df[:, part * FILTERS:(part + 1) * FILTERS]
                dh[:, self.value] += df[:, None, FILTERS:2 * FILTERS] / self.value.sum()
                dh *= h > 0
                dcols = (dh @ self.p["conv"].T).reshape(len(idx), -1, KERNEL, CHANNELS)
                demb = np.zeros_like(self.p["emb"])
                for k in range(KERNEL):
                    np.add.at(demb, xb[:, k:k + dcols.shape[1]], dcols[:, :, k])
                g = {"out": f.T @ d, "ob": d.sum(keepdims=True), "cb": dh.sum((0, 1)),
                     "conv": cols.reshape(-1, KERNEL * CHANNELS).T @ dh.reshape(-1, FILTERS), "emb": demb}
                step += 1
                for k, gk in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    s[k] = 0.999 * s[k] + 0.001 * gk * gk
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling and the threshold from counts: ``n`` cases of label ``y`` with
        a logit of ``z`` or little more.

        The threshold always keeps the wanted recall.  Of those that let no more through
        than the highest one that keeps it, the nearest to one half is taken."""
        pos, neg = float(n[y == 1].sum()), float(n[y == 0].sum())
        if not pos:
            return
        want = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, c = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            h = n * np.maximum(p * (1 - p), 1e-6)
            g = np.array([(n * (p - want) * z).sum() + 0.05 * a, (n * (p - want)).sum() + 0.05 * c])
            step = np.linalg.solve([[(h * z * z).sum() + 0.05, (h * z).sum()], [(h * z).sum(), h.sum() + 0.05]], g)
            a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
        # A higher logit must stay a higher probability.
        self.scale, self.shift = (float(a), float(c)) if a > 0.01 else (1.0, 0.0)
        good, other = np.unique(z[(y == 1) & (n > 0)]), np.unique(z[(y == 0) & (n > 0)])
        kept = np.array([n[(y == 1) & (z >= v)].sum() for v in good])
        top = good[kept >= recall * pos].max()
        below = other[other < top]
        low = below.max() + 1 / BINS if len(below) else -np.inf
        half = -self.shift / self.scale
        self.cut = float(min(top, max(low, half)))
        self.threshold = 0.5 if self.cut == half else float(self.chance(np.array(self.cut)))


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = TRAIN_DOCS,
          cases: int = TRAIN_CASES) -> Network:
    """Fit on the labelled findings of about ``sample_docs`` documents, calibrate on
    the candidates of all."""
    small_batches(docs.sparkSession)
    n = docs.count()
    key = F.pmod(F.xxhash64(F.col(text_col), F.lit("secrets")), F.lit(1 << 20)) / float(1 << 20)
    chosen = docs.where(F.col(text_col).isNotNull() & (key < min(1.0, sample_docs / max(n, 1)))).select(text_col)

    def run(batches):
        word = re.compile(r"\w{6,}")
        for b in batches:
            label, win = [], []
            for t in b.column(0).to_pylist():
                base = base_spans(t)
                for y, w in cases_of(t, base):
                    if y is not None:
                        label += [y] * len(w)
                        win += [x.tobytes() for x in w]
                plain = word.search(t, len(t) // 2)
                if plain and all(plain.end() <= s or plain.start() >= e for s, _, e in base):
                    label.append(0)
                    win.append(window(t, *plain.span()).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(win, pa.binary())], ["y", "x"])

    found = chosen.mapInArrow(tidy(run), "y int, x binary").distinct()
    net = Network()
    parts = [found.where(F.col("y") == v).orderBy(F.xxhash64("x"), "x").limit(cases).collect() for v in (1, 0)]
    if not all(parts):
        return net
    rows = [r for p in parts for r in p]
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.uint8).reshape(len(rows), WIDTH)
    y = np.array([r.y for r in rows], np.float32)
    net.train(x, y)
    net.calibrate(*score_counts(docs, net, text_col))
    return net


def score_counts(docs: DataFrame, net: Network, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit, label, count) per score bin of the candidates of all documents, base
    ones included; a candidate's score is the greatest of its stretches.  At most
    two rows a bin reach the driver."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            counts = np.zeros((2, 2 * SPAN * BINS), np.int64)
            for lo, hi in slices(texts, CHARS):
                label, sizes, win = [], [], []

                def count():
                    z = np.maximum.reduceat(net.logits(np.stack(win)), np.cumsum([0, *sizes[:-1]]))
                    at = np.clip(np.floor((z + SPAN) * BINS), 0, counts.shape[1] - 1).astype(np.int64)
                    np.add.at(counts, (label, at), 1)

                for t in texts[lo:hi]:
                    for y, w in cases_of(t, base_spans(t)):
                        if y is not None:
                            label.append(y)
                            sizes.append(len(w))
                            win += w
                            if len(win) >= 4096:
                                count()
                                label, sizes, win = [], [], []
                if win:
                    count()
            y, at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[y, at])],
                                             ["y", "at", "n"])

    found = docs.select(text_col).mapInArrow(tidy(run), "y int, at int, n bigint")
    rows = sorted(tuple(r) for r in found.groupBy("y", "at").agg(F.sum("n")).collect())
    y, at, n = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0),) * 3
    # The lower edge, so that a bin's cases all reach a threshold at it.
    return at / BINS - SPAN, y, n.astype(np.float64)


def cases_of(text: str, base: list[tuple[int, int, int]]):
    """(label, windows) of the candidates of a text: 1 for a base finding, 0 for
    another one, None for a short value after a base rule's name."""
    for s, k, e in base:
        # The value alone counts: a name in front is part of the context.
        v = _ASSIGN.match(text, s).start(1) if k == 0 else s
        shown = zlib.crc32(text[v:e].encode("utf-8", "replace")) & 1
        yield 1, windows_of(text, v, e) if shown else unnamed(text, s, v, e)
    told = [m.end() for m in _TOLD.finditer(text)]
    for s, e in wide_spans(text, base):
        named = bisect.bisect_left(told, s) < bisect.bisect_left(told, e)
        yield None if named else 0, windows_of(text, s, e)


def passing(texts: list[str], asked: list[tuple[int, int, int]], net: Network) -> dict[int, list[tuple[float, int, int]]]:
    """Per text the (probability, start, end) of the stretches that reach the
    threshold, for candidates (text, start, end); neighbouring stretches of a
    candidate are one, with the greatest probability."""
    parts = [(k, s, e) for k, (_, a, b) in enumerate(asked) for s, e in stretches(a, b)]
    out: dict[int, list[tuple[float, int, int]]] = {}
    good: dict[int, list[tuple[int, int, float]]] = {}
    for j in range(0, len(parts), 4096):
        some = parts[j:j + 4096]
        z = net.logits(np.stack([window(texts[asked[k][0]], s, e) for k, s, e in some]))
        p = net.chance(z)
        for i in np.flatnonzero(np.maximum(z, -SPAN) >= net.cut):
            k, s, e = some[i]
            good.setdefault(k, []).append((s, e, float(p[i])))
    for k, own in good.items():
        at = 0
        for s, e in merged([x[:2] for x in own]):
            best = 0.0
            while at < len(own) and own[at][0] < e:
                best, at = max(best, own[at][2]), at + 1
            out.setdefault(asked[k][0], []).append((best, s, e))
    return out


def chosen(found: list[tuple[float, int, int]], taken: list[tuple[int, int]]) -> tuple[list, list]:
    """(taken with the spans chosen, rests of the others).  Of overlapping spans
    the most probable one (in hundredths) is chosen, among equals the longest, then
    the first; a rest is the part of another one outside all chosen spans."""
    taken, lost, rests = sorted(taken), [], set()
    for _, s, e in sorted(found, key=lambda x: (-round(x[0], 2), x[1] - x[2], x[1])):
        i = bisect.bisect_left(taken, (s, e))
        if (i and taken[i - 1][1] > s) or (i < len(taken) and taken[i][0] < e):
            lost.append((s, e))
        else:
            taken.insert(i, (s, e))
    for s, e in lost:
        rests.update(outside(s, e, taken))
    return taken, sorted(rests)


def findings(texts: list[str], net: Network | None) -> list[list[tuple[int, int, int]]]:
    """(start, kind index, end) of every text, base and model findings in order;
    the model's kind comes after the listed ones.

    Rests of candidates beaten by a more probable one are scored once more by
    themselves, so what lies beside a finding is neither lost nor taken along."""
    out = [base_spans(t) for t in texts]
    if net is None or net.threshold > 1:
        return out
    for lo, hi in slices(texts, CHARS):
        asked = [(i, s, e) for i in range(lo, hi) for s, e in wide_spans(texts[i], out[i])]
        first = {i: chosen(f, []) for i, f in passing(texts, asked, net).items()}
        rests = passing(texts, [(i, s, e) for i, (_, r) in first.items() for s, e in r], net)
        for i, (taken, _) in first.items():
            for s, e in chosen(rests.get(i, []), taken)[0]:
                out[i].append((s, len(KINDS), e))
    return [sorted(f) for f in out]


def scan(docs: DataFrame, net: Network | None, text_col: str = "text", redacted: bool = True) -> DataFrame:
    """``docs`` without its text plus n_assign, n_access, n_hex, n_model,
    base_sha256, spans and, where wanted, the redacted text."""
    small_batches(docs.sparkSession)
    kinds = (*KINDS, MODEL_KIND)
    made = {*(f"n_{k}" for k in kinds), "base_sha256", "spans", "redacted"}
    keep = [c for c in docs.columns if c != text_col and c not in made]
    place, at = docs.columns.index(text_col), [docs.columns.index(c) for c in keep]
    names = [*(f"n_{k}" for k in kinds), "base_sha256", "spans", *(["redacted"] if redacted else [])]

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(place).to_pylist()]
            found = findings(texts, net)
            cols: list[list] = [[] for _ in names]
            for t, f in zip(texts, found):
                tag = [f"{kinds[k]}:{s}:{e}" for s, k, e in f]
                base = ",".join(x for x, g in zip(tag, f) if g[1] < len(KINDS))
                row = [sum(g[1] == k for g in f) for k in range(len(kinds))]
                row += [hashlib.sha256(base.encode()).hexdigest(), ",".join(tag)]
                row += [redact(t, f)] if redacted else []
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * len(kinds) + [pa.string()] * 3
            types = types[:len(names)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             [*keep, *names])

    tail = ", ".join([f"n_{k} bigint" for k in kinds] + [f"{c} string" for c in names[len(kinds):]])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.mapInArrow(tidy(run), f"{schema}, {tail}" if schema else tail)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every stretch covered by a finding replaced by one mark."""
    if not found:
        return text
    out, at = [], 0
    for s, _, e in found:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on ``docs``' own findings, then scan every row."""
    rows = docs.select(id_col, text_col)
    return scan(rows, train(rows, text_col), text_col, redacted=False)
