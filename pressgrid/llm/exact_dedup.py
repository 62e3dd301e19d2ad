"""Exact de-duplication with a two-pass Bloom filter.

Texts are equal when they are identical after every run of ASCII white space
(``[\\x20\\x09-\\x0D]+``) is replaced by one space; null counts as empty.

Pass 1 counts, per bit position, how many rows set it (two positions per row,
taken from the text's hash, partial counts map-side) and keeps the positions
set at least twice: a Bloom filter of the *possibly repeated* hashes.  Pass 2
tests every row against that filter.  Rows that fail it are provably unique
and pass straight through; only the others are grouped by their full SHA-256,
and only groups of two or more become part of the lookup that marks copies.

Cases: null and empty texts form one group; rows that repeat the smallest
``doc_id`` of their group are all marked kept (they are the same document), and
``drop_duplicates`` keeps one of them; a
null ``doc_id`` is never the smallest unless the whole group has none; an
empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from .common import free_name, packed, stored, text_or_empty

# Bits of the filter per row, and the largest filter (2^36 bits).  The size
# follows the input; a filter too large to broadcast is joined by shuffle.
BITS_PER_ROW = 16
MAX_BITS_LOG2 = 36
# At most this many rows of the filter (64 bits each) or of the group table
# (about 100 bytes each) are broadcast.
BROADCAST_ROWS = 500_000
# log2 of the largest filter of rows to drop: 64 bits a word, 8 MB.
DROP_BITS = 25
# A text repeated at least this often is salted in a shuffle join.
HOT_ROWS = 100_000
SALTS = 64


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def text_key(text: Column | str) -> Column:
    """SHA-256 of the normalised text, lowercase hex."""
    return F.sha2(normalised(text), 256)


def _positions(key: Column, bits: int) -> list[Column]:
    """Two bit positions from one 64-bit hash of the key."""
    h = F.xxhash64(key)
    return [h.bitwiseAND(F.lit(bits - 1)),
            F.shiftrightunsigned(h, 64 - (bits.bit_length() - 1))]


def repeated_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The Bloom filter of possibly repeated keys: (word, bits64)."""
    p = keys.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("p"))
    twice = p.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    word, bit = F.shiftright("p", 6), F.expr("shiftleft(1L, cast(p & 63 as int))")
    return twice.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits64"))


def _flagged(rows: DataFrame, key: str, words: DataFrame, bits: int, flag: str) -> DataFrame:
    """``rows`` with the boolean ``flag``: both positions are set in the filter."""
    hit = F.lit(True)
    drop = []
    for i, p in enumerate(_positions(F.col(key), bits)):
        w, b, at = (free_name(rows, f"_{x}{i}") for x in ("w", "b", "p"))
        side = words.select(F.col("word").alias(w), F.col("bits64").alias(b))
        rows = rows.withColumn(at, p).join(side, F.shiftright(F.col(at), 6) == F.col(w), "left")
        hit = hit & (F.expr(f"shiftrightunsigned({b}, cast({at} & 63 as int)) & 1") == 1)
        drop += [w, b, at]
    return rows.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(*drop)


class Duplicates:
    """The groups of equal texts of one table, found from (doc_id, key) rows."""

    def __init__(self, keys: DataFrame, id_col: str = "doc_id", key: str = "text_sha256"):
        self.id_col, self.key = id_col, key
        n = keys.count()
        self.bits = 1 << min(MAX_BITS_LOG2, max(16, (BITS_PER_ROW * n - 1).bit_length()))
        words = stored(repeated_filter(keys, key, self.bits), "bloom")
        self.words = broadcast_if_small(words, BROADCAST_ROWS)
        cand = _flagged(keys, key, self.words, self.bits, "_maybe").where("_maybe")
        self.groups = stored(cand.groupBy(key).agg(F.min(id_col).alias("keep_id"),
                                                   F.count(F.lit(1)).alias("group_size"))
                             .where(F.col("group_size") > 1), "groups")
        self.small = self.groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def mark(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with the key column) plus keep_id, group_size and kept.

        Unique rows stay where they are.  The lookup is broadcast while its
        size is proven small; otherwise the possibly repeated rows, and only
        those, are joined by a salted shuffle."""
        keep, size, maybe = (free_name(rows, c) for c in ("_keep", "_size", "_maybe"))
        flagged = _flagged(rows, self.key, self.words, self.bits, maybe)
        look = self.groups.select(F.col(self.key).alias("_k"), F.col("keep_id").alias(keep),
                                  F.col("group_size").alias(size))
        if self.small:
            out = flagged.join(F.broadcast(look), F.col(maybe) & (F.col(self.key) == F.col("_k")), "left").drop("_k")
        else:
            salt = free_name(rows, "_salt")
            salts = F.when(F.col(size) >= HOT_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))) \
                .otherwise(F.array(F.lit(0)))
            hot = F.broadcast(look.where(F.col(size) >= HOT_ROWS).select(F.col("_k").alias("_hk")))
            cand = flagged.where(F.col(maybe)).join(hot, F.col(self.key) == F.col("_hk"), "left") \
                .withColumn(salt, F.when(F.col("_hk").isNotNull(), F.pmod(F.xxhash64(self.id_col), F.lit(SALTS)))
                            .otherwise(F.lit(0)).cast("int")).drop("_hk")
            side = look.withColumn("_s", F.explode(salts))
            joined = cand.join(side, (F.col(self.key) == F.col("_k")) & (F.col(salt) == F.col("_s")), "left") \
                .drop("_k", "_s", salt)
            rest = flagged.where(~F.col(maybe)).withColumn(keep, F.lit(None).cast(look.schema[keep].dataType)) \
                .withColumn(size, F.lit(None).cast("long"))
            out = joined.unionByName(rest.select(*joined.columns))
        alone = F.col(size).isNull()
        return (out.withColumn("keep_id", F.when(alone, F.col(self.id_col)).otherwise(F.col(keep)))
                .withColumn("group_size", F.coalesce(F.col(size), F.lit(1).cast("long")))
                .withColumn("kept", F.col("keep_id").eqNullSafe(F.col(self.id_col)))
                .drop(keep, size, maybe))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    The text is read and hashed once; everything after works on stored
    (id, hash) rows."""
    keys = stored(docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_sha256")), "keys")
    return Duplicates(keys).mark(keys)


def without_copies(docs: DataFrame, key, gone: DataFrame, again: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows named in ``gone`` and with one row of each named in
    ``again``; both hold distinct (i, x): an id and the value of ``key`` over ``in.*``.

    Both sets are broadcast while their size is proven small.  Beyond it a Bloom filter
    of at most ``DROP_BITS`` bits, which is broadcast whatever the size, tells in the scan
    which rows may be named, and only those are shuffled with their text."""
    own = F.col(f"in.{id_col}").cast(gone.schema["i"].dataType)
    rows = packed(docs).select("in", own.alias("id"), key.alias("x"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("x") == F.col("x_"))
    gone, again = (d.select("i", F.col("x").alias("x_")) for d in (gone, again))
    named = broadcast_if_small(gone, BROADCAST_ROWS), broadcast_if_small(again, BROADCAST_ROWS)
    passed = None
    if named[0] is gone or named[1] is again:
        words, bits = _named_filter(gone.unionByName(again))
        rows = _flagged(rows.withColumn("k", F.xxhash64("id", "x")), "k", F.broadcast(words), bits, "maybe")
        passed, rows = rows.where(~F.col("maybe")).select("in"), rows.where("maybe").drop("maybe", "k")
    rows = rows.join(named[0], same, "left_anti")
    if again.isEmpty():
        out = rows.select("in")
    else:
        # Copies of a row meet map-side before one of them is shuffled.
        once = rows.join(named[1], same, "left_semi").dropDuplicates(["id", "x"])
        out = rows.join(named[1], same, "left_anti").select("in").unionByName(once.select("in"))
    return (out if passed is None else out.unionByName(passed)).select("in.*")


def _named_filter(named: DataFrame) -> tuple[DataFrame, int]:
    """A Bloom filter (word, bits64) of (i, x_) rows, and its bits."""
    n = named.count()
    bits = 1 << min(DROP_BITS, max(10, (BITS_PER_ROW * n).bit_length()))
    p = named.select(F.explode(F.array(*_positions(F.xxhash64("i", "x_"), bits))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    return stored(p.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit).alias("bits64")), "named"), bits


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of equal texts, columns unchanged; of
    rows that repeat the smallest id of their group (or all have none) one stays.

    Groups are found on stored (id, hash) rows.  A text shuffles only when its row is
    repeated, or may be to drop while those are too many to broadcast."""
    keys = stored(docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_sha256")), "keys")
    marked = Duplicates(keys).mark(keys).where("group_size > 1")
    named = stored(marked.groupBy(F.col("doc_id").alias("i"), F.col("text_sha256").alias("x"))
                   .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "copies")
    return without_copies(docs, text_key(F.col(f"in.{text_col}")), named.where("not kept"),
                          named.where("kept and n > 1"), id_col)
