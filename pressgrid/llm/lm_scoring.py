"""Log probabilities of texts under a context-mixing model of a corpus.

Texts are lower-cased (A-Z) first.  Two models learn from the training rows:

* the base counts tokens (words between white space, then one end): a text's base score
  is the sum of log10((c + 1) / (N + V + 1)) over its tokens;
* the bit model (module ``mixing``) predicts every bit of the text's bytes and its end
  by online logistic mixing of hashed contexts; its score is the log10 probability of
  the whole lower-cased text.

Every part of both learns from every training row, in four scans of them: letters (for
the code tree); tokens and the model's counts; the odds before every bit (for the
weights); the mixed odds and matches (for the refinement and the trust in matches).  Every
task of a scan sends the tokens it counted and its tables, cut into ``CHUNK`` counters a
row, and Spark adds them up, so no row is left out and what is gathered grows with the
corpus.  The tables are of fixed size, and fitting needs their sums alone.

One scan scores all rows.  The model is of fixed size and broadcast, and so are the most
frequent tokens: at most ``HOT_TOKENS`` of at most ``HOT_BYTES`` bytes.  Tokens that are
not among them leave the scan with the row, once per text, and meet their counts in a
shuffle join, so the vocabulary may have any size.  Tokens are compared as strings, never
by a hash.

Cases: a null text counts as empty (one token, the end); a null id is a training row;
repeated rows are rows of their own and get equal results; very long texts are scored in
blocks; without training rows every count is 0, the base score is 0 and the bit model
predicts even odds; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mixing
from .common import small_batches, stored, text_or_empty, tidy

HOT_TOKENS = 500_000
HOT_BYTES = 64
FLUSH_TOKENS = 4_000_000     # tokens that a task counts together
TOGETHER = 6 << 20           # bytes of text that a task scores together
CHUNK = 1 << 17              # counters in one row
END_TOKEN = " "              # no word holds a space


def held_out(id_col: str) -> Column:
    """The rows that never take part in training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _words(texts):
    """(words of all texts, index of the text of each) of lower-cased texts."""
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.not_equal(flat, "")
    return flat.filter(full), np.asarray(parent.filter(full))


def _bytes(texts) -> list[bytes]:
    return pc.cast(texts, pa.binary()).to_pylist()


def gathered(rows: DataFrame, code: mixing.Code) -> DataFrame:
    """What the tasks count in the training texts: rows of (token, n), and rows of
    (part, counts) for every chunk of the count tables that is not empty."""
    def run(batches):
        counter, tokens, held, ends = mixing.Counter(code), [], 0, 0

        def counted():
            words = pa.chunked_array(tokens, pa.string()).dictionary_encode().combine_chunks()
            n = np.bincount(np.asarray(words.indices), minlength=len(words.dictionary))
            return words.dictionary, n

        def batch(token, n, part, counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(token, pa.string()), pa.array(n, pa.int64()), pa.array(part, pa.int32()),
                 pa.array(counts, pa.binary())], ["token", "n", "part", "counts"])

        def out():
            words, n = counted()
            return batch(words, n, [None] * len(n), [None] * len(n))

        for b in batches:
            texts = pc.ascii_lower(b.column(0))
            counter.add(_bytes(texts))
            words, _ = _words(texts)
            ends += len(texts)
            tokens.append(words.cast(pa.string()))
            held += len(words)
            if held >= FLUSH_TOKENS:
                yield out()
                tokens, held = [], 0
        if tokens:
            yield out()
        counter.flush()
        if ends:
            yield batch([END_TOKEN], [ends], [None], [None])
        for part, counts in _chunks(counter.tables):
            yield batch([None], [None], [part], [counts])

    return rows.select("t").mapInArrow(tidy(run), "token string, n long, part int, counts binary")


def counted(rows: DataFrame, counter) -> list[np.ndarray]:
    """The tables of ``counter()`` over all texts: one counter per task, added up."""
    def run(batches):
        mine = counter()
        for b in batches:
            mine.add(_bytes(pc.ascii_lower(b.column(0))))
        mine.flush()
        for part, counts in _chunks(mine.tables):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts], pa.binary())],
                                             ["part", "counts"])

    got = added(rows.select("t").mapInArrow(tidy(run), "part int, counts binary")).collect()
    tables = [np.zeros(len(t), np.int64) for t in counter().tables]
    _put(tables, ((r.part, np.frombuffer(r.counts, np.int64)) for r in got))
    return tables


def _chunks(tables: list[np.ndarray]):
    """(part, packed counts) for every ``CHUNK`` counters of the tables that are not all 0."""
    part = 0
    for table in tables:
        for first in range(0, len(table), CHUNK):
            piece = table[first:first + CHUNK]
            if piece.any():
                yield part, _packed(np.pad(piece, (0, CHUNK - len(piece))))
            part += 1


def _put(tables: list[np.ndarray], parts) -> None:
    """The counts of ``parts`` in their places of the tables."""
    places = [(t, first) for t in tables for first in range(0, len(t), CHUNK)]
    for part, counts in parts:
        table, first = places[part]
        table[first:first + CHUNK] = counts[:len(table) - first]


def _packed(counts: np.ndarray) -> bytes:
    """Small counts as bytes, the larger ones after them (place and value)."""
    large = np.flatnonzero(counts >= 255)
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + large.astype("<u4").tobytes() + counts[large].astype("<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, CHUNK).astype(np.int64)
    n = (len(data) - CHUNK) // 12
    counts[np.frombuffer(data, "<u4", n, CHUNK)] = np.frombuffer(data, "<u8", n, CHUNK + 4 * n)
    return counts


def summed(parts: DataFrame) -> DataFrame:
    """(part, counts as 64-bit integers): the chunks of all tasks added up, as a stream
    over the rows of a part."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(data, np.int64) if len(data) == 8 * CHUNK else _unpacked(data)
                sums[part] = sums[part] + got if part in sums else got
        for part, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())],
                                             ["part", "counts"])

    return parts.select("part", "counts").mapInArrow(tidy(run), "part int, counts binary")


def added(parts: DataFrame) -> DataFrame:
    """The sums of all chunks: first where the rows are, then per part."""
    return summed(summed(parts).repartition("part"))


def started(parts: DataFrame, code: mixing.Code) -> mixing.Untied:
    """What fitting starts from: the model's count tables meet in one task, which turns
    them into odds.  They are of fixed size; the driver gets the odds alone."""
    def run(batches):
        tables = [np.zeros(2 << b, np.int64) for b in mixing.TABLE_BITS]
        for b in batches:
            _put(tables, ((part, np.frombuffer(data.as_buffer(), np.int64))
                          for part, data in zip(b.column(0).to_pylist(), b.column(1))))
        start = zlib.compress(pickle.dumps(mixing.untied(code, tables)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([start], pa.binary())], ["start"])

    got = added(parts).repartition(1).mapInArrow(tidy(run), "start binary").collect()
    if not got:      # no task without a row
        return mixing.untied(code, [np.zeros(2 << b, np.int64) for b in mixing.TABLE_BITS])
    return pickle.loads(zlib.decompress(got[0].start))


def fitted(rows: DataFrame, start: mixing.Untied) -> mixing.Model:
    """The model with weights, refinement and trust in matches fitted on all of ``rows``."""
    sc = rows.sparkSession.sparkContext
    for counter, fit in ((mixing.OddsCounter, mixing.fit_weights), (mixing.RefineCounter, mixing.fit_refinement)):
        sent = sc.broadcast(start)
        fit(start, *counted(rows, _Counters(counter, sent)))
        sent.destroy()       # the driver's copy too
    return start.model


class _Counters:
    """Makes a counter that starts from a broadcast value."""

    def __init__(self, kind, sent):
        self.kind, self.sent = kind, sent

    def __call__(self):
        return self.kind(self.sent.value)


def hot_threshold(counts: DataFrame) -> int | None:
    """The smallest count of a hot token: at most ``HOT_TOKENS`` short tokens have it.
    None if even the highest class has more."""
    c = F.col("c")
    step = F.when(c < 1024, c).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(c.cast("double")))).cast("long"))
    classes = (counts.where(F.octet_length("token") <= HOT_BYTES).groupBy(step.alias("step"))
               .agg(F.count("*").alias("n")).collect())
    held, least = 0, None
    for r in sorted(classes, key=lambda r: -r.step):
        held += r.n
        if held > HOT_TOKENS:
            break
        least = r.step
    return least


def train(rows: DataFrame):
    """(bit model, token counts) of the training rows (columns id, t)."""
    (letters,) = counted(rows, mixing.LetterCounter)
    code = mixing.Code(letters + 1)
    found = stored(gathered(rows, code), "gathered")
    model = fitted(rows, started(found.where("part IS NOT NULL"), code))
    counts = stored(found.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("c")), "tokens")
    return model, counts


def _larger(batches):
    """Batches put together until their texts have ``TOGETHER`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(2).nbytes
        if size >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    for b in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
        yield b


def scored(rows: DataFrame, sent: Broadcast, cold: bool) -> DataFrame:
    """``rows`` (id, held_out, t) scored by the model and hot tokens sent: n_bytes, bits, n_tokens, of the hot tokens the
    number known and the sum of log10(c + 1), and the other tokens (``cold``) with their
    number."""
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", "held_out", "n_bytes", "bits", "n_tokens", "known", "logs", "rest"]

    def run(batches):
        model, hot = sent.value
        value_set, c = hot["token"].combine_chunks(), np.append(np.asarray(hot["c"]), 0)
        logs = np.log10(c + 1.0)
        for b in _larger(batches):
            texts = pc.ascii_lower(b.column(2))
            rows, data = len(texts), _bytes(texts)
            bits = mixing.score_texts(model, data)
            words, parent = _words(texts)
            parent = np.append(parent, np.arange(rows))
            words = pa.concat_arrays([words.cast(pa.string()), pa.array([END_TOKEN] * rows, pa.string())])
            words = words.dictionary_encode()
            which = np.asarray(words.indices)
            at = np.asarray(pc.fill_null(pc.index_in(words.dictionary, value_set=value_set), len(c) - 1))[which]
            hit = at < len(c) - 1
            known = np.bincount(parent[hit], minlength=rows)
            total = np.bincount(parent, logs[at], rows)
            if cold:
                pairs, n = np.unique(parent[~hit].astype(np.int64) << 32 | which[~hit], return_counts=True)
                offsets = np.searchsorted(pairs >> 32, np.arange(rows + 1)).astype(np.int32)
                rest = pa.StructArray.from_arrays([words.dictionary.take(pa.array(pairs & 0xFFFFFFFF)),
                                                   pa.array(n, pa.int64())], ["token", "n"])
            else:
                offsets = np.zeros(rows + 1, np.int32)
                rest = pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], ["token", "n"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(d) for d in data], pa.int64()), pa.array(bits),
                 pa.array(np.bincount(parent, minlength=rows)), pa.array(known), pa.array(total),
                 pa.ListArray.from_arrays(pa.array(offsets), rest)], names)

    return rows.select("id", "held_out", "t").mapInArrow(
        tidy(run), f"id {id_type}, held_out boolean, n_bytes long, bits double, n_tokens long, known long, "
                   "logs double, rest array<struct<token:string,n:bigint>>")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"),
                       text_or_empty(text_col).alias("t"))
    model, counts = train(rows.where(~F.col("held_out")))
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least = hot_threshold(counts)
    is_hot = F.lit(False) if least is None else (F.col("c") >= least) & (F.octet_length("token") <= HOT_BYTES)
    hot = counts.where(is_hot).toArrow()
    cold = counts.where(~is_hot)
    some = hot.num_rows < size.v
    sent = docs.sparkSession.sparkContext.broadcast((model, hot))
    del model, hot
    out = stored(scored(rows, sent, some).withColumn("r", F.monotonically_increasing_id()), "scored")
    sent.destroy()
    known, logs = F.col("known"), F.col("logs")
    if some:
        rest = out.select("r", F.explode("rest").alias("x")).select("r", "x.token", "x.n")
        met = (rest.join(cold, "token").groupBy("r")
               .agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs")))
        out = out.drop("rest").join(met, "r", "left")
        known = known + F.coalesce("more", F.lit(0))
        logs = logs + F.coalesce("more_logs", F.lit(0.0))
    room = float(np.log10(size.n + size.v + 1.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", known.alias("n_known"),
        F.lit(size.n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(room)).alias("base_score"),
        (F.col("bits") * F.lit(-float(np.log10(2.0)))).alias("score"),
        "n_bytes", (F.col("bits") / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"))
