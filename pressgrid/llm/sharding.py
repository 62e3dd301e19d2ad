"""Sharding by histogram sort: equal bytes per shard, one exchange.

Rows are ordered by (hash of the text, hash of the id), so equal texts are
neighbours and the order is independent of how the input is partitioned.  The
boundaries between shards are found by counting: each round sums the bytes of
the rows below evenly spaced probe keys inside every interval that still holds
a boundary, keeps the probes that meet the tolerance and refines the rest.
Only (probe, bytes, rows) histograms reach the driver, at most
``(shards - 1) * 2^PROBE_BITS`` rows a round.  When all boundaries are settled,
the rows are exchanged once.

Law: *bytes*.  A boundary lies within ``tolerance`` (a share of one shard) of
its exact place, or on the nearer edge of the one row that covers that place.
Groups of equal texts stay in one shard unless a boundary would then miss the
tolerance; such a group (a hot one) is split by the id's hash.

Cases: a null text has no bytes and CRC 0; an empty table gives an empty
result; null or repeated ids are rows like any other; rows equal in id and
text have the same key and stay together, whatever their number.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, shared_path, stored, text_or_empty

ROW_OVERHEAD = 16   # bytes a row counts besides its text
PROBE_BITS = 10     # probes a round: 2^10 in every open interval
MIN_LONG, MAX_LONG = -(1 << 63), (1 << 63) - 1
CELLS = 64          # numbering cells per shard, at least
ROWS_PER_CELL = 20_000


def shard_keys(id_col: str, text_col: str) -> dict[str, Column]:
    """The two sort keys and the size of a row."""
    text = text_or_empty(text_col)
    return {"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.col(id_col)),
            "_size": (F.octet_length(text) + ROW_OVERHEAD).cast("long")}


def _histogram(rows: DataFrame, key: str, shift: int) -> list[tuple[int, int, int, int, int]]:
    """(prefix, bytes, rows, smallest key, largest key) in key order."""
    return sorted(tuple(r) for r in rows.groupBy(F.shiftright(key, shift).alias("b")).agg(
        F.sum("_size"), F.count(F.lit(1)), F.min(key), F.max(key)).collect())


def _settle(rows: DataFrame, key: str, targets: list[int], base: int, slack: float) -> tuple[dict, dict]:
    """Place the byte offsets ``targets`` among ``rows`` ordered by ``key``.

    Returns {target: first key value of the next shard} for settled targets and
    {target: (key value, bytes below it)} for those inside one key value.
    ``base`` is the number of bytes before ``rows``."""
    done, inside = {}, {}
    shift, open_ = 64, {None: (base, list(targets))}
    while open_:
        step = min(PROBE_BITS, shift)
        part = rows if None in open_ else rows.where(F.shiftright(key, shift).isin(sorted(open_)))
        nxt, hist = shift - step, {}
        for h in _histogram(part, key, nxt):
            hist.setdefault(None if shift == 64 else h[0] >> step, []).append(h)
        following = {}
        for prefix, (below, wanted) in open_.items():
            ends, at = [], below
            for h in hist[prefix]:
                at += h[1]
                ends.append(at)
            for t in wanted:
                i = bisect.bisect_left(ends, t)
                b, size, n, lo, hi = hist[prefix][i]
                start = ends[i] - size
                near_end = ends[i] - t < t - start
                edge = MAX_LONG if hi == MAX_LONG else hi + 1
                if min(t - start, ends[i] - t) <= slack or n == 1:
                    done[t] = edge if near_end else lo
                elif lo == hi:
                    inside[t] = (lo, start)
                else:
                    following.setdefault(b, (start, []))[1].append(t)
        open_, shift = following, nxt
    return done, inside


def find_splitters(rows: DataFrame, shards: int, tolerance: float = 0.0025) -> list[tuple[int, int]]:
    """``shards - 1`` boundary keys; ``rows`` has _k1, _k2 and _size.

    Every round is one aggregation over the narrow rows."""
    total = rows.agg(F.sum("_size")).first()[0]
    if not total:
        return [(MAX_LONG, MAX_LONG)] * (shards - 1)
    slack = tolerance * total / shards
    targets = sorted({total * j // shards for j in range(1, shards)})
    first, inside = _settle(rows, "_k1", targets, 0, slack)
    place = {t: (k, MIN_LONG) for t, k in first.items()}
    by_key: dict[int, tuple[int, list[int]]] = {}
    for t, (k, start) in inside.items():
        by_key.setdefault(k, (start, []))[1].append(t)
    for k, (start, wanted) in by_key.items():  # at most shards - 1 hot texts
        second, same = _settle(rows.where(F.col("_k1") == k), "_k2", wanted, start, slack)
        place.update({t: (k, v) for t, v in second.items()})
        place.update({t: (k, v) for t, (v, _) in same.items()})
    return sorted(place[total * j // shards] for j in range(1, shards))


def _shard_of(splitters: list[tuple[int, int]], lo: int, hi: int) -> Column:
    """The number of splitters at or below the row's key, by binary search."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    a, b = splitters[mid]
    above = (F.col("_k1") > a) | ((F.col("_k1") == a) & (F.col("_k2") >= b))
    return F.when(above, _shard_of(splitters, mid + 1, hi)).otherwise(_shard_of(splitters, lo, mid))


def assign_shards(rows: DataFrame, splitters: list[tuple[int, int]], cells: int = CELLS) -> DataFrame:
    """``rows`` (with the key columns) plus shard and slot.

    Slots are numbered per (shard, cell) behind the offsets of a table with at
    most ``shards * cells`` rows, so no task numbers a whole shard."""
    n = len(splitters) + 1
    shard, cell, off = "shard", "_cell", "_offset"
    out = rows.withColumn(shard, _shard_of(splitters, 0, n - 1)) \
        .withColumn(cell, F.pmod(F.xxhash64("_k1", "_k2", "_size"), F.lit(cells)).cast("int"))
    counts = out.groupBy(shard, cell).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(off))
    number = F.row_number().over(Window.partitionBy(shard, cell).orderBy("_k1", "_k2"))
    out = out.withColumn("slot", number.cast("long") - 1)
    return out.join(F.broadcast(offsets), [shard, cell]) \
        .withColumn("slot", F.col("slot") + F.col(off)).drop(cell, off)


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                    tolerance: float = 0.0025) -> DataFrame:
    """Every row of ``docs`` with ``shard`` and ``slot`` (gapless from 0 in its shard);
    existing columns of these names are replaced.

    The boundaries are found on stored (key, size) rows; the documents
    themselves are read once more and exchanged once."""
    narrow = stored(docs.select(*[c.alias(n) for n, c in shard_keys(id_col, text_col).items()]), "shard-keys")
    splitters = find_splitters(narrow, shards, tolerance)
    wide = packed(docs).withColumns(shard_keys(f"in.{id_col}", f"in.{text_col}"))
    out = assign_shards(wide, splitters, _cells(narrow.count(), shards))
    keep = [F.col(f"in.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return out.select(*keep, "shard", "slot")


def _cells(n: int, shards: int) -> int:
    return max(CELLS, -(-n // (shards * ROWS_PER_CELL)))


def shard_digest(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                 tolerance: float = 0.0025) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot) of the documents as ``shard_documents``
    deals them out, read back from the shards written to the shared folder."""
    dealt = written_shards(shard_documents(docs.select(id_col, text_col), shards, id_col, text_col, tolerance))
    return dealt.select(id_col, shard_keys(id_col, text_col)["_size"].alias("size"),
                        F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"),
                        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def written_shards(dealt: DataFrame) -> DataFrame:
    """Write dealt documents whole, one folder a shard, and read them back."""
    path = shared_path(dealt.sparkSession, "shards")
    dealt.write.partitionBy("shard").parquet(path)
    return dealt.sparkSession.read.schema(dealt.schema).parquet(path)
