"""Removal of repeated long strings by difference-cover suffix sorting.

Texts are UTF-8 bytes.  Every byte covered by a string of ``LENGTH`` bytes that
also starts anywhere else (same document included) is removed; strings are
judged on the input and never cross documents.

1. *Parse.*  Every start of a ``LENGTH``-byte string is assigned the smallest
   hash among the ``GRAM``-byte grams inside that string.  Consecutive starts
   with the same smallest hash form a phrase: the bytes from its first start to
   the end of its last string.  Equal strings have equal smallest hashes, so two
   equal strings always lie in phrases of one class, each in exactly one place.
2. *Prune.*  Phrases are counted per class and per content with partial
   aggregation.  A class met once is unique and is dropped; a phrase met twice
   or more is repeated throughout.
3. *Sort.*  The remaining distinct phrases are exchanged by class.  Each task
   sorts the suffixes of its classes with the difference-cover algorithm (sort
   the sampled triples, recurse on their names, merge the remaining suffixes)
   and compares the ``LENGTH``-byte prefixes of neighbours; a start equal to a
   neighbour is repeated.
4. *Remove.*  Repeated starts become byte ranges per document.

A byte-level sort of the whole corpus would move several times the input per
round; the parse leaves only the stretches that can differ.  A class of more than
``HOT_PHRASES`` distinct phrases or ``SORT_BYTES`` bytes is not gathered: its strings are counted by hash
with partial aggregation instead, which gives the same answer.

Cases: null and empty texts and texts under ``LENGTH`` bytes keep every byte;
very long texts are parsed in pieces; texts that repeat inside themselves
(periodic ones) are found through grams met twice in a phrase; repeated rows
repeat each other and lose their long strings; null or repeated ids are told
apart by the text's hash; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from .common import small_batches, stored, tidy

LENGTH = 400
GRAM = 128
PIECE = 500_000            # starts parsed at once
# Bytes of phrases sorted together: at most twice this, so that three names of a
# sort fit 63 bits.
SORT_BYTES = 1 << 20
HOT_PHRASES = 2_000
BROADCAST_CLASSES = 1_000_000
BROADCAST_DOCS = 250_000

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_power: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "b" not in _power or len(_power["b"]) < n:
        for name, base in (("b", _BASE), ("i", _INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _power[name] = np.multiply.accumulate(a)
    return _power["b"], _power["i"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """64-bit hashes of any stretch of a byte string, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start]
                    + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - 1
        return _mix((self.sums[size:] - self.sums[:-size]) * self.inverse[:n - size + 1]
                    + np.uint64(size * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


def phrases(data: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple]:
    """Arrays (class hash, first start, starts, content hash, met twice) per piece
    of a text."""
    out, width = [], length - gram + 1
    for at in range(0, len(data) - length + 1, PIECE):
        part = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - at), at)
        hashes = Hashes(part)
        h = hashes.windows(gram)
        m = len(h)
        rows = np.concatenate([h, np.full(-m % width, 2 ** 64 - 1, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[:m - width + 1], ahead[width - 1:m])
        lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        n = np.diff(lo, append=len(least))
        end = lo + n - 1 + length
        # Grams equal to the phrase's smallest: more than one may mean a repeat inside.
        low = np.flatnonzero(np.isin(h, least[lo]))
        twice = np.zeros(len(lo), bool)
        if len(low) > 1:
            order = np.lexsort((low, h[low]))
            low = low[order]
            near = (h[low][1:] == h[low][:-1]) & (low[1:] - low[:-1] <= n.max() + length)
            for a, b in zip(low[:-1][near], low[1:][near]):
                k = np.searchsorted(lo, a + gram, "right")
                for j in range(max(0, np.searchsorted(lo, a - length) - 1), min(k, len(lo))):
                    twice[j] |= least[lo[j]] == h[a] and lo[j] <= a and b + gram <= end[j]
        out.append((least[lo], lo + at, n, hashes.of(lo, end), twice))
    return out


# --------------------------------------------------------------- suffix order

def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffixes of the integer string ``s`` in order, by difference cover modulo 3:
    each level names two thirds of the positions, so all levels together sort
    three times the string's length."""
    n = len(s)
    if n < 4:
        t = s.tolist()
        return np.array(sorted(range(n), key=lambda i: t[i:]), np.int64)
    t = np.concatenate([s.astype(np.int64) + 1, np.zeros(3, np.int64)])
    # Sampled positions: 1 modulo 3, then 2 modulo 3.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    bits = int(t.max()).bit_length()
    key = (t[sample] << 2 * bits) | (t[sample + 1] << bits) | t[np.minimum(sample + 2, n + 2)]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[0], (key[order][1:] != key[order][:-1]).cumsum()])
    if new[-1] + 1 < len(sample):
        name = np.empty(len(sample), np.int64)
        name[order] = new
        order = suffix_order(name)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    rank[n:] = 0
    sample = sample[order]
    zero = np.arange(0, n, 3)
    rb = int(len(sample) + 1).bit_length()
    k0 = (t[zero] << rb) | rank[zero + 1]
    o0 = np.argsort(k0, kind="stable")
    zero, k0 = zero[o0], k0[o0]
    s1, s2 = sample[sample % 3 == 1], sample[sample % 3 == 2]
    below = np.searchsorted((t[s1] << rb) | rank[s1 + 1], k0)
    wide = (t[zero] << bits + rb) | (t[zero + 1] << rb) | rank[zero + 2]
    below += np.searchsorted((t[s2] << bits + rb) | (t[s2 + 1] << rb) | rank[s2 + 2], wide)
    out = np.empty(n + (n % 3 == 1), np.int64)
    at = np.arange(len(zero)) + below
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at], out[rest] = zero, sample
    return out[out < n]


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per phrase, which of its starts begin a string that another start of any
    phrase begins as well: neighbours in suffix order with equal prefixes."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    first = np.cumsum(size) - size
    starts = np.zeros(len(text), bool)
    for f, n in zip(first, size):
        starts[f:f + n - length + 1] = True
    order = suffix_order(text)
    order = order[starts[order]]
    prefix = np.zeros(len(text), np.uint64)
    w = Hashes(text).windows(length)
    prefix[:len(w)] = w
    same = prefix[order][1:] == prefix[order][:-1]
    hit = np.zeros(len(text), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return [hit[f:f + n - length + 1] for f, n in zip(first, size)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


# ---------------------------------------------------------------------- Spark

def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for i, x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = (t or "").encode()
                for h, lo, n, c, twice in phrases(data, length, gram):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array([i] * len(h), pa.int64()),
                         pa.array(np.full(len(h), x, np.int64)), pa.array(lo.astype(np.int64)),
                         pa.array(n.astype(np.int32)), pa.array(twice)],
                        ["h", "c", "id", "x", "lo", "n", "twice"])

    def gathered(batches):  # one record batch per few thousand phrases
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows > 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return docs.mapInArrow(tidy(gathered), "h bigint, c bigint, id bigint, x bigint, lo bigint, n int, twice boolean")


def _texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, hot, id, x, lo, w, text) for the phrases in ``wanted``, cut from ``docs``."""
    lists = wanted.groupBy("id", "x").agg(F.collect_list(F.struct("h", "lo", "n", "w", "hot")).alias("ps"))
    lists = broadcast_if_small(stored(lists, "phrase-lists").withColumnsRenamed({"id": "_i", "x": "_x"}), BROADCAST_DOCS)
    rows = docs.join(lists, docs["id"].eqNullSafe(F.col("_i")) & (docs["x"] == F.col("_x"))).select("id", "x", "t", "ps")

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for i, x, t, ps in zip(*(b.column(k).to_pylist() for k in range(4))):
                data = t.encode()
                for p in ps:
                    row = (p["h"], p["hot"], i, x, p["lo"], p["w"], data[p["lo"]:p["lo"] + p["n"] - 1 + length])
                    for c, v in zip(cols, row):
                        c.append(v)
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["h", "hot", "id", "x", "lo", "w", "text"])

    return rows.mapInArrow(tidy(run), "h bigint, hot boolean, id bigint, x bigint, lo bigint, w bigint, text binary")


def _sorted_ranges(batches, length: int):
    """Repeated start ranges of phrases that arrive class by class."""
    held, size, last = [], 0, None

    def flush():
        parts = [r[4] for r in held]
        cols: list[list] = [[] for _ in range(4)]
        for r, hit in zip(held, repeated_starts(parts, length)):
            for s, e in _runs(hit):
                for c, v in zip(cols, (r[1], r[2], r[3] + s, r[3] + e - 1 + length)):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "x", "s", "e"])

    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(5))):
            if row[0] != last and size > SORT_BYTES:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
            last = row[0]
    if held:
        yield flush()


def _string_hashes(batches, length: int):
    """Every string of the phrases of hot classes with its place."""
    for b in batches:
        for h, i, x, lo, w, t in zip(*(b.column(k).to_pylist() for k in range(6))):
            g = Hashes(np.frombuffer(t, np.uint8)).windows(length)
            n = len(g)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, h, np.int64)), pa.array(g.view(np.int64)), pa.array([i] * n, pa.int64()),
                 pa.array(np.full(n, x, np.int64)), pa.array(lo + np.arange(n)), pa.array(np.full(n, w, np.int64))],
                ["h", "g", "id", "x", "s", "w"])


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                    hot_phrases: int = HOT_PHRASES) -> DataFrame:
    """(id, x, s, e): byte ranges of repeated strings; ``docs`` has id, x, t."""
    spark = docs.sparkSession
    occ = stored(_occurrences(docs, length, gram), "phrases")
    classes = occ.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c0"), F.max("c").alias("c1"),
                                   F.max("twice").alias("t2")).where("k > 1 or t2") \
        .select("h", (F.col("t2") | (F.col("c0") != F.col("c1"))).alias("mixed"))
    classes = broadcast_if_small(stored(classes, "classes"), BROADCAST_CLASSES)
    met = stored(occ.join(classes, "h"), "repeated-phrases")
    # Distinct phrases with their number and one place each.
    kinds = stored(met.groupBy("h", "c").agg(F.count(F.lit(1)).alias("w"), F.max("mixed").alias("mixed"),
                                             F.min(F.struct("id", "x", "lo", "n")).alias("p")), "phrase-kinds")
    copies = broadcast_if_small(kinds.where("w > 1").select("h", "c"), BROADCAST_CLASSES)
    whole = met.join(copies, ["h", "c"]).select("id", "x", F.col("lo").alias("s"),
                                                (F.col("lo") + F.col("n") - 1 + length).alias("e"))
    hot = stored(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("p.n") + length).alias("b"))
                 .where((F.col("k") > hot_phrases) | (F.col("b") > SORT_BYTES))
                 .select("h", F.lit(True).alias("hot")), "hot-classes")
    wanted = kinds.where("mixed").select("h", "p.*", "w").join(broadcast_if_small(hot), "h", "left") \
        .withColumn("hot", F.coalesce("hot", F.lit(False)))
    texts = stored(_texts(docs, wanted, length), "phrase-texts")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cold = texts.where(~F.col("hot")).select("h", "id", "x", "lo", "text").repartition(tasks, "h") \
        .sortWithinPartitions("h", "id", "x", "lo")
    out = whole.unionByName(cold.mapInArrow(tidy(lambda b: _sorted_ranges(b, length)),
                                            "id bigint, x bigint, s bigint, e bigint"))
    if hot.limit(1).count():
        strings = texts.where("hot").select("h", "id", "x", "lo", "w", "text").mapInArrow(
            tidy(lambda b: _string_hashes(b, length)), "h bigint, g bigint, id bigint, x bigint, s bigint, w bigint")
        strings = stored(strings, "hot-strings")
        twice = stored(strings.groupBy("h", "g").agg(F.sum("w").alias("k")).where("k > 1").select("h", "g"), "hot-repeats")
        out = out.unionByName(strings.join(twice, ["h", "g"]).select("id", "x", "s", (F.col("s") + length).alias("e")))
    return out


def _merged(pairs: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((p["s"], p["e"]) for p in pairs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, hot_phrases: int = HOT_PHRASES, with_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]) per row; ``kept``
    holds the remaining bytes (a cut may fall inside a character)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("x"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ranges = repeated_ranges(rows, length, gram, hot_phrases)
    lists = ranges.groupBy("id", "x").agg(F.collect_set(F.struct("s", "e")).alias("cut"))
    lists = broadcast_if_small(stored(lists, "removed").withColumnsRenamed({"id": "_i", "x": "_x"}), BROADCAST_DOCS)
    joined = rows.join(lists, rows["id"].eqNullSafe(F.col("_i")) & (rows["x"] == F.col("_x")), "left") \
        .select("id", "t", "cut")

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for i, t, cut in zip(*(b.column(k).to_pylist() for k in range(3))):
                data, at, kept = t.encode(), 0, []
                spans = _merged(cut or [])
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                left = b"".join([*kept, data[at:]]) if spans else data
                row = (i, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(),
                       ",".join(f"{s}:{e}" for s, e in spans), left)
                for c, v in zip(cols, row):
                    c.append(v)
            types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.binary())
            made = [pa.array(c, t) for c, t in zip(cols, types)][:7 if with_bytes else 6]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256",
                                                    "spans", "kept"][:len(made)])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string"
    return joined.mapInArrow(tidy(run), schema + (", kept binary" if with_bytes else ""))
