"""Token ids in directly addressable codes, written and read back as files.

Every id is cut into 8-bit chunks, lowest first.  Level ``k`` holds the k-th
chunk of every id that has one, and a continuation bitmap (one bit per chunk:
does the id go on to the next level?).  A rank directory (set bits before
every 512-bit block) turns a position on one level into the position on the
next, so any single id is read from its own chunks alone, without decoding a
block.

File layout, little-endian: ``b"DAC1"``, count u64, levels u32, then per level:
entries u64, the chunks (u8), the bitmap (u8, 8 entries a byte, lowest first),
the directory (u32, one per started 512-bit block).

Documents are range-partitioned and sorted by id; every task writes blocks of
about ``BLOCK_IDS`` ids as rows of a Parquet table (part, block, doc_ids, counts,
codes), which commits atomically on any store and survives lost executors.

Cases: a null or empty text is the end id alone; a very long text is one block
of its own; rows with equal ids are ordered by their text's hash, nulls first;
an empty table writes no block and gives an empty result; only the id and text
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, small_batches, tidy

MAGIC = b"DAC1"
RANK_BLOCK = 512
BLOCK_IDS = 1_000_000
END_ID = 0
# Encoded words kept per worker (about 200 MB), and words encoded at a time.
CACHE_WORDS = 900_000
JOINED_WORDS = 2_000
TOGETHER = 16 << 20          # bytes of text whose distinct words are found together


# ---------------------------------------------------------------- file format

def dac_encode(ids: np.ndarray) -> bytes:
    """The file image of an array of unsigned 32-bit ids."""
    rest = np.asarray(ids, dtype=np.uint32)
    levels = []
    while True:
        chunks = (rest & 0xFF).astype(np.uint8)
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        starts = np.arange(0, len(more), RANK_BLOCK)
        ones = np.add.reduceat(more.astype(np.uint32), starts) if len(more) else np.zeros(0, np.uint32)
        rank = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(struct.pack("<Q", len(chunks)) + chunks.tobytes() + bits.tobytes() + rank.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    return MAGIC + struct.pack("<QI", len(ids), len(levels)) + b"".join(levels)


class DacReader:
    """Random access into one file image; nothing is copied when it is opened."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token code file")
        self.n, levels = struct.unpack_from("<QI", image, 4)
        at, self.levels = 16, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", image, at)
            at += 8
            parts = []
            for kind, size in ((np.uint8, n), (np.uint8, -(-n // 8)), (np.dtype("<u4"), -(-n // RANK_BLOCK))):
                a = np.frombuffer(image, kind, size, at)
                at += a.nbytes
                parts.append(a)
            self.levels.append(parts)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The i-th id, from at most one chunk and one directory block per level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bits, rank, i)
        return value

    @staticmethod
    def _rank(bits, rank, i: int) -> int:
        """Set bits before position ``i``."""
        block = i // RANK_BLOCK
        inside = np.unpackbits(bits[block * RANK_BLOCK // 8: (i >> 3) + 1], bitorder="little")
        return int(rank[block]) + int(inside[: i - block * RANK_BLOCK].sum())

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end): the needed stretch of every level, no more."""
        out = np.zeros(end - start, np.uint32)
        where = None  # positions in out that have a chunk on this level
        for k, (chunks, bits, rank) in enumerate(self.levels):
            part = chunks[start:end].astype(np.uint32) << (8 * k)
            if where is None:
                out |= part
            else:
                out[where] |= part
            more = np.unpackbits(bits[start >> 3: (end + 7) >> 3], bitorder="little")[start & 7:][: end - start]
            step = np.flatnonzero(more)
            if not len(step):
                break
            start = self._rank(bits, rank, start)
            end = start + len(step)
            where = step if where is None else where[step]
        return out


# ------------------------------------------------------------------- encoding

# A space after a character that is not white space always starts a new
# pre-token, so texts are cut there; the class is a superset of the library's.
_OTHER_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + \
    "\u2028\u2029\u202f\u205f\u3000"
# Texts that are not cut: other white space, a space after white space, white
# space at an end.
_UNCUT = f"^ |[ \n]$|  |\n |[{_OTHER_SPACES}]"
# So does punctuation after a letter or a digit, if no apostrophe is part of it; only
# letters that every Unicode version has are taken.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_TAIL = f"([0-9{_LETTERS}])([!-&(-/:-@\\[-`{{-~]+)( |$)"


def _written() -> dict[int, str]:
    """The character by which byte-level vocabularies write every byte but the newline."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(other) if b != 10}}


class WordEncoder:
    """The library's ids for whole texts, with the ids of words kept.

    A text is cut only where the pre-tokenizer must cut, so the ids equal those
    of the whole text: at spaces, and a word also around single newlines and in front
    of its last punctuation.  Each distinct part is encoded once by the library:
    one of letters alone is one pre-token and goes to the library's model at once."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        if special_as_text:
            self.tok.encode_special_tokens = True
        self.model, self.written = self.tok.model, _written()
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # Byte-level vocabularies write every byte as one character.
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = [len(t) for t in vocab]
        self._clear()

    def _clear(self) -> None:
        # Parts that follow a space (kept without it), and other pieces as they are.
        self.after_space: dict[str, int] = {}
        self.as_is: dict[str, int] = {}
        # Entry 0 is the end id that closes every text.
        self.flat, self.lens = np.array([END_ID], np.uint32), np.array([1], np.int64)
        self.starts, self.uses = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _shrink(self) -> None:
        """Forget the parts that were met only once; everything if that is not enough."""
        kept = self.uses > 1
        kept[0] = True
        if self.lens[kept].sum() > 4 * CACHE_WORDS or kept.sum() > CACHE_WORDS // 2:
            return self._clear()
        place = np.cumsum(kept) - 1
        self.flat = self.flat[np.repeat(kept, self.lens)]
        self.lens = self.lens[kept]
        self.starts = np.cumsum(self.lens) - self.lens
        self.uses = np.zeros(len(self.lens), np.int64)
        for known in (self.after_space, self.as_is):
            left = {w: int(place[c]) for w, c in known.items() if kept[c]}
            known.clear()
            known.update(left)

    def _add(self, known: dict, words: list[str], ids: list[np.ndarray], lens: list[np.ndarray]) -> None:
        known.update(zip(words, range(len(self.lens), len(self.lens) + len(words))))
        size = np.concatenate(lens)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(size) - size])
        self.lens = np.concatenate([self.lens, size])
        self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])
        self.flat = np.concatenate([self.flat, *ids])

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that follow a space, encoded as one text; the tokens' byte
        lengths show where each word ends."""
        ids = np.array(self.tok.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(np.asarray(pc.binary_length(pa.array(words, pa.large_string()))) + 1)
        upto = np.cumsum(self.bytes_of[ids])
        last = np.searchsorted(upto, ends)
        if last[-1] < len(upto) and (upto[last] == ends).all():
            return ids, np.diff(last + 1, prepend=0)
        return self._each([" " + w for w in words])

    def _letters(self, words: list[str], space: str) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone, each one pre-token (``space`` in front of it)."""
        space = space.translate(self.written)
        words = "\n".join(words).encode().decode("latin-1").translate(self.written).split("\n")
        got = [self.model.tokenize(space + w) for w in words]
        return np.array([t.id for g in got for t in g], np.uint32), np.array([len(g) for g in got], np.int64)

    def _codes(self, known: dict, pieces: pa.Array, space: str) -> np.ndarray:
        """The entry of every piece, which has ``space`` in front of it."""
        pieces = pieces.dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = list(map(known.get, distinct))
        new = np.array([i for i, c in enumerate(code) if c is None], np.int64)
        if len(new):
            words = pieces.dictionary.take(pa.array(new))
            alone = np.asarray(pc.and_not(pc.match_substring_regex(words, f"^[{_LETTERS}]+$"), self._special(words)))
            others = self._joined if space else self._each
            for mine, encode in ((alone, lambda w: self._letters(w, space)), (~alone, others)):
                some = words.filter(pa.array(mine)).to_numpy(zero_copy_only=False).tolist()
                got = [encode(some[i:i + JOINED_WORDS]) for i in range(0, len(some), JOINED_WORDS)]
                if got:
                    self._add(known, some, [g[0] for g in got], [g[1] for g in got])
            code = list(map(known.__getitem__, distinct))
        return np.array(code, np.int64)[np.asarray(pieces.indices)]

    def _special(self, words: pa.Array) -> pa.Array:
        """Which words hold one of the library's added tokens."""
        special = pa.array(np.zeros(len(words), bool))
        for content in self.added:
            special = pc.or_(special, pc.match_substring(words, content))
        return special

    def _parts(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(parts of all words, parts of each): a single newline inside a word and the
        punctuation at its end are pre-tokens of their own."""
        whole = self._special(words)
        lines = pc.and_not(pc.match_substring(words, "\n"),
                           pc.or_(whole, pc.match_substring_regex(words, "^\n|\n\n")))
        cut = pc.if_else(lines, pc.replace_substring(words, "\n", " \n "), words)
        cut = pc.if_else(whole, words, pc.replace_substring_regex(cut, _TAIL, r"\1 \2\3"))
        parts = pc.split_pattern(cut, " ")
        return parts.flatten(), np.asarray(pc.list_value_length(parts)).astype(np.int64)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, ids per text)."""
        if len(self.lens) > CACHE_WORDS or len(self.flat) > 8 * CACHE_WORDS:
            self._shrink()
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # A text is its first piece and the words after a space; one with runs of
        # white space, or white space at an end, is one piece.
        uncut = pc.match_substring_regex(texts, _UNCUT)
        plain = ~np.asarray(uncut)
        count = np.zeros(len(texts), np.int64)
        parts = pc.split_pattern(texts.filter(pc.invert(uncut)), " ")
        count[plain] = np.asarray(pc.list_value_length(parts)).astype(np.int64) - 1
        flat = parts.flatten()
        begin = np.cumsum(count[plain] + 1) - count[plain] - 1
        after = np.ones(len(flat), bool)
        after[begin] = False
        firsts = np.zeros(len(texts), np.int64)
        pieces = pa.concat_arrays([flat.take(pa.array(begin)), texts.filter(uncut)])
        words = flat.filter(pa.array(after)).dictionary_encode()
        which = np.asarray(words.indices)
        cut, n = self._parts(words.dictionary)
        front = np.zeros(len(cut), bool)
        front[np.cumsum(n) - n] = True
        # Entries of the parts of the distinct words, and of the first pieces.
        code = np.zeros(len(cut), np.int64)
        code[front] = self._codes(self.after_space, cut.filter(pa.array(front)), " ")
        as_is = self._codes(self.as_is, pa.concat_arrays([cut.filter(pa.array(~front)), pieces]), "")
        code[~front], firsts[plain], firsts[~plain] = np.split(as_is, np.cumsum([len(cut) - len(n), len(begin)]))
        met = np.bincount(which, minlength=len(n))
        self.uses += np.bincount(code, np.repeat(met, n), len(self.uses)).astype(np.int64)
        self.uses += np.bincount(firsts, minlength=len(self.uses))
        # The ids of every distinct word, after those of the first pieces and the end id
        # (a text's pieces are its first piece, its words and the end).
        entries = np.concatenate([firsts, [0], code])
        size = self.lens[entries]
        table = self.flat[_places(self.starts[entries], size)]
        lens = np.add.reduceat(size, np.concatenate([np.arange(len(texts) + 1), len(texts) + 1 + np.cumsum(n) - n]))
        begin = np.cumsum(count + 2) - count - 2
        piece = np.full(len(which) + 2 * len(texts), len(texts))
        piece[begin] = np.arange(len(texts))
        piece[np.arange(len(which)) + np.repeat(2 * np.arange(len(texts)) + 1, count)] = which + len(texts) + 1
        size = lens[piece]
        ids = table[_places((np.cumsum(lens) - lens)[piece], size)]
        return ids, np.add.reduceat(size, begin)


def _places(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of stretches that begin at ``starts``, one stretch after the other."""
    upto = np.cumsum(lens)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - upto + lens, lens)


_encoders: dict = {}  # one encoder per worker process, kept from task to task


def _encoder(path: str, special_as_text: bool) -> WordEncoder:
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, special_as_text)
    return _encoders[key]


def _larger(batches):
    """Batches put together until their texts have ``TOGETHER`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(1).nbytes
        if size >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _blocks(path: str, special_as_text: bool):
    def run(batches):
        enc = _encoder(path, special_as_text)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held, keys, counts, size = [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())),
                 pa.array([dac_encode(np.concatenate(held))], pa.binary())],
                ["part", "block", "start", "doc_ids", "counts", "codes"])

        for b in _larger(batches):
            ids = b.column(0).to_pylist()
            got, n = enc.encode(pc.fill_null(b.column(1), ""))
            at = 0
            for i, k in zip(ids, n.tolist()):
                if size and size + k > BLOCK_IDS:
                    yield row()
                    block, start, held, keys, counts, size = block + 1, start + size, [], [], [], 0
                held.append(got[at:at + k])
                keys.append(i)
                counts.append(k)
                at, size = at + k, size + k
        if keys:
            yield row()
    return run


SCHEMA = ("part int, block int, start bigint, doc_ids array<bigint>, counts array<int>, codes binary")


def write_codes(docs: DataFrame, out: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                special_as_text: bool = False) -> None:
    """Encode every document and write the code files to folder ``out`` in
    ascending id order (part, then block, then place in the block)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    # The second key splits an id that holds very many rows.
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("i", "h").sortWithinPartitions("i", "h")
    rows.select("i", "t").mapInArrow(tidy(_blocks(tokenizer_path, special_as_text)), SCHEMA).write.parquet(out)


def _digest(batches):
    for b in batches:
        for part, start, keys, counts, codes in zip(*(b.column(i).to_pylist() for i in range(5))):
            ids = DacReader(codes).read(0, sum(counts)).astype("<u4")
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends.tolist(), counts)]
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(np.full(len(n), part, np.int32)),
                 pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())],
                ["doc_id", "part", "start", "n_tokens", "ids_crc32"])


def read_digest(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    The offset of a part is a running sum over one row per part."""
    small_batches(files.sparkSession)
    sizes = files.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")) \
        .groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    rows = files.select("part", "start", "doc_ids", "counts", "codes").mapInArrow(
        tidy(_digest), "doc_id bigint, part int, start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("start") + F.col("off")).alias("start"), "n_tokens", "ids_crc32")


def token_code_digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Write ``docs`` as code files in the shared folder, then read them back."""
    spark = docs.sparkSession
    out = shared_path(spark, "token-codes")
    write_codes(docs, out, tokenizer_path, id_col, text_col)
    return read_digest(spark.read.schema(SCHEMA).parquet(out))
