"""Jaccard similarity join of word shingles with a token-group matrix.

A document's set is its distinct shingles of ``WORDS`` consecutive words (A-Z
lower-cased, words split at ASCII white space; fewer words: the whole sequence
as one shingle).  Two documents link when ``100 * |A & B| >= 75 * |A | B|``.

1. *Sets.*  Every text becomes a set of 64-bit shingle hashes; documents with equal
   sets share a 128-bit signature and one of them stands for all.
2. *Shared shingles.*  Blocks of representatives send each distinct shingle once,
   with the documents of the block that hold it, to the task of its hash range;
   shingles held by one set only are dropped.  A document of which fewer than
   75 % of the shingles are shared cannot link and is done.
3. *Groups.*  The rest are partitioned into groups of similar documents: in a few
   rounds, the documents with the same smallest shingle hash are compared with
   one of them, and linked documents form a group.  Groups are cut into parts of at most about ``PART`` members.
4. *Matrix.*  For every group the distinct prefix shingles of its members (rarest
   first; two linked documents share one) are the group's columns of the
   token-group matrix.  A document meets a foreign group only through a shared
   column from which enough shingles are left on both sides.  Its overlap with the union of the group's shingles bounds its overlap
   with every member, and only groups that reach 75 % of the document's own size
   are opened and compared member by member.
5. *Components.*  Links and group memberships are joined to components by
   alternating star contractions.

Members of one group are connected already, so no pairs inside a group are made;
copies are never expanded.

Cases: null or empty texts and texts without words have no shingle, link with
nothing and are their own component; very long texts are hashed in pieces;
repeated rows and ids are one set and so one component; a null id never is the
smallest of a component that has another; an empty table gives an empty result;
only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from .common import small_batches, stored, tidy
from .exact_dedup import without_copies

WORDS = 5
PERCENT = 75
BLOCK_CHARS = 6_000_000   # text of one block, at least one document
BLOCK_DOCS = 16_000
PART_TOKENS = 2_000_000   # shingles of one hash range, about
HEAVY = 64                # a shingle in more documents of a block sends its count only
PART = 256                # members of a group part
ROUNDS = 3                # hashes under which groups are formed
BROADCAST_ROWS = 500_000
NAME_BYTES = 6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F], np.uint64)
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


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a byte array."""
    data = _LOWER[data]
    gap = _SPACE[data]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return start, _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _ODD[1])


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    out: list[np.ndarray] = []
    joined, ends = [], []
    size = 0

    def flush():
        if not joined:
            return
        start, h = _word_hashes(np.frombuffer(b" ".join(joined), np.uint8))
        cut = np.searchsorted(start, ends)
        windows = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            windows += h[k:k + len(windows)] * _ODD[k]
        windows = _mix(windows)
        a = 0
        for b in cut.tolist():
            if b - a >= WORDS:
                out.append(np.unique(windows[a:b - WORDS + 1]))
            elif b > a:
                short = (h[a:b] * _ODD[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(_mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            a = b
        joined.clear()
        ends.clear()

    for t in texts:
        data = (t or "").encode()
        if size > 4_000_000:
            flush()
            size = 0
        joined.append(data)
        size += len(data) + 1
        ends.append(size)
    flush()
    return out


def _signature(s: np.ndarray) -> str:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def signatures(rows: DataFrame) -> DataFrame:
    """(doc_id, x, n, sig) of every row; sig is null for an empty set."""
    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_signature(s) if len(s) else None for s in sets], pa.string())], ["doc_id", "x", "n", "sig"])

    return rows.mapInArrow(tidy(run), "doc_id bigint, x bigint, n bigint, sig string")


# ------------------------------------------------------------ shared shingles

def _pack(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def _unpack(data: bytes) -> bytes:
    return zstandard.decompress(data)


def _planes(a: np.ndarray, width: int) -> bytes:
    """Byte planes of little-endian integers: sorted values compress well."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplane(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def _entry(key: np.ndarray, count: np.ndarray, docs: np.ndarray) -> bytes:
    """Sorted shingles with the number and the list of their documents."""
    head = np.array([len(key), len(docs)], "<u4").tobytes()
    return head + _pack(_planes(key, NAME_BYTES) + _planes(count, 2) + _planes(docs, 2))


def _read_entry(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, d = np.frombuffer(b, "<u4", 2).tolist()
    raw, w = _unpack(b[8:]), NAME_BYTES
    return (_unplane(raw, n, w), _unplane(raw[n * w:], n, 2).astype(np.int64),
            _unplane(raw[n * (w + 2):], d, 2).astype(np.int64))


HEAVY_MARK = 0xFFFF


def _block_rows(block: int, sigs: list[str], sets: list[np.ndarray], parts: int, heavy_docs: int):
    """What one block sends: to every hash range its shingles, and to itself the
    documents with their sizes and the document lists of heavy shingles."""
    n = np.array([len(s) for s in sets])
    h = _names(np.concatenate(sets))
    doc = np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    # Two hashes of one document with one name count once.
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    h, doc = h[once], doc[once]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    key, count = h[first], np.diff(first, append=len(h))
    heavy = count > heavy_docs
    light = ~np.repeat(heavy, count)
    sent = np.where(heavy, HEAVY_MARK, count)
    part = _range_of(key, parts)
    own = np.repeat(part, count)
    kp, dp = np.searchsorted(part, np.arange(parts + 1)), np.searchsorted(own, np.arange(parts + 1))
    for p in range(parts):
        ks, ds = slice(kp[p], kp[p + 1]), slice(dp[p], dp[p + 1])
        if kp[p] < kp[p + 1]:
            yield p, block, 0, _entry(key[ks] - _base(p, parts), sent[ks], doc[ds][light[ds]])
    # To itself, by way of any range.
    lists = np.flatnonzero(heavy)
    body = np.concatenate([doc[first[i]:first[i] + count[i]] for i in lists]) if len(lists) else np.zeros(0, np.int64)
    self_row = b"".join([np.array([len(sets), len(lists), len(body)], "<u4").tobytes(), n.astype("<u4").tobytes(),
                         "".join(sigs).encode(), key[heavy].tobytes(), count[heavy].astype("<u4").tobytes(),
                         body.astype("<u2").tobytes()])
    yield block % parts, block, 1, _pack(self_row)


def _names(h: np.ndarray) -> np.ndarray:
    """48 bits of a shingle hash, its name from here on: the highest 32, which
    also give the hash range, and the lowest 16."""
    return (h >> np.uint64(32)) << np.uint64(16) | h & np.uint64(0xFFFF)


def _range_of(name: np.ndarray, parts: int) -> np.ndarray:
    return ((name >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _base(part: int, parts: int) -> np.uint64:
    """The smallest name of a hash range; names travel relative to it."""
    return np.uint64(-(-(part << 32) // parts) << 16)


def _send(parts: int, heavy_docs: int, block_docs: int):
    """Tasks over the texts of representatives."""
    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        sigs: list[str] = []
        sets: list[np.ndarray] = []
        seen: set[str] = set()
        size = 0

        def flush():
            cols = list(zip(*_block_rows(task << 20 | seq, sigs, sets, parts, heavy_docs)))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                 pa.array(cols[3], pa.binary())], ["part", "block", "kind", "data"])

        for b in batches:
            texts = b.column(0).to_pylist()
            for t, s in zip(texts, shingle_sets(texts)):
                sig = _signature(s)
                if not len(s) or sig in seen:
                    continue
                if sets and (size + len(t) > BLOCK_CHARS or len(sets) >= block_docs):
                    yield flush()
                    sigs, sets, seen, size, seq = [], [], set(), 0, seq + 1
                sigs.append(sig)
                seen.add(sig)
                sets.append(s)
                size += len(t)
        if sets:
            yield flush()
    return run


def _receive(batches, parts: int, heavy_docs: int):
    """Per hash range: the shingles held by two sets or more go back to the blocks
    that sent them, named and with the number of sets; other rows pass through."""
    part, blocks, entries = None, [], []

    def flush():
        read = [_read_entry(e) for e in entries]
        own = np.concatenate([r[1] for r in read])
        which = np.repeat(np.arange(len(read)), [len(r[0]) for r in read])
        key = np.concatenate([r[0] for r in read])
        # A heavy shingle counts as many documents as make it heavy, at least.
        weight = np.where(own == HEAVY_MARK, heavy_docs + 1, own)
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        total = np.add.reduceat(weight[order], np.flatnonzero(first))
        df = np.empty(len(key), np.int64)
        df[order] = total[np.cumsum(first) - 1]
        cols: list[list] = [[], []]
        for i, (k, c, d) in enumerate(read):
            mine = df[which == i] if len(read) > 1 else df
            keep = mine > 1
            docs = np.where(c == HEAVY_MARK, 0, c)
            head = np.array([part, int(keep.sum()), int(docs[keep].sum())], "<u4").tobytes()
            body = _planes(k[keep] + _base(part, parts), NAME_BYTES) + _planes(c[keep], 2) + \
                _planes(np.minimum(mine[keep], 0xFFFFFFFF), 4) + _planes(d[np.repeat(keep, docs)], 2)
            cols[0].append(blocks[i])
            cols[1].append(head + _pack(body))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array([0] * len(cols[0]), pa.int32()), pa.array(cols[1], pa.binary())],
            ["block", "kind", "data"])

    for b in batches:
        for p, block, kind, data in zip(*(b.column(i).to_pylist() for i in range(4))):
            if kind == 1:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([1], pa.int32()),
                                                  pa.array([data], pa.binary())], ["block", "kind", "data"])
                continue
            if p != part and entries:
                yield flush()
                blocks, entries = [], []
            part = p
            blocks.append(block)
            entries.append(data)
    if entries:
        yield flush()


def _candidates():
    """Per block: the documents of which enough shingles are shared, with those
    shingles, rarest first."""
    def finish(own: bytes, returned: list[bytes]):
        raw = _unpack(own)
        docs, lists, body = np.frombuffer(raw, "<u4", 3).tolist()
        at = 12
        n = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        sigs = raw[at:at + 32 * docs].decode()
        at += 32 * docs
        heavy = np.frombuffer(raw, "<u8", lists, at)
        at += 8 * lists
        sizes = np.frombuffer(raw, "<u4", lists, at).astype(np.int64)
        listed = np.frombuffer(raw, "<u2", body, at + 4 * lists).astype(np.int64)
        place = dict(zip(heavy.tolist(), zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist())))
        tok, df, doc = [], [], []
        for r in returned:
            _, k, d = np.frombuffer(r, "<u4", 3).tolist()
            raw, w = _unpack(r[12:]), NAME_BYTES
            name = _unplane(raw, k, w)
            count = _unplane(raw[k * w:], k, 2).astype(np.int64)
            number = _unplane(raw[k * (w + 2):], k, 4).astype(np.int64)
            holders = _unplane(raw[k * (w + 6):], d, 2).astype(np.int64)
            plain = count != HEAVY_MARK
            tok.append(np.repeat(name[plain], count[plain]))
            df.append(np.repeat(number[plain], count[plain]))
            doc.append(holders)
            for m, f in zip(name[~plain].tolist(), number[~plain].tolist()):
                a, c = place[m]
                tok.append(np.full(c, m, np.uint64))
                df.append(np.full(c, f, np.int64))
                doc.append(listed[a:a + c])
        if not tok:
            return
        tok, df, doc = np.concatenate(tok), np.concatenate(df), np.concatenate(doc)
        need = -(-PERCENT * n // 100)
        keep = (np.bincount(doc, minlength=docs) >= need)[doc]
        tok, df, doc = tok[keep], df[keep], doc[keep]
        order = np.lexsort((tok, df, doc))
        tok, doc = tok[order], doc[order]
        edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else []
        for a, b in zip(edge, [*edge[1:], len(doc)]):
            d, t = int(doc[a]), tok[a:b]
            yield (sigs[32 * d:32 * d + 32], int(n[d]), int(t[_mix(t).argmin()]), int(b - a - need[d] + 1),
                   t.astype(np.int64))

    def made(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
             pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.list_(pa.int64()))],
            ["sig", "n", "least", "prefix", "toks"])

    def run(batches):
        block, own, returned = None, None, []
        for b in batches:
            for k, kind, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k != block and own is not None:
                    rows = list(finish(own, returned))
                    if rows:
                        yield made(rows)
                    own, returned = None, []
                block = k
                if kind == 1:
                    own = data
                else:
                    returned.append(data)
        if own is not None:
            rows = list(finish(own, returned))
            if rows:
                yield made(rows)
    return run


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def candidates(rows: DataFrame, sets: DataFrame, heavy_docs: int = HEAVY, block_docs: int = BLOCK_DOCS,
               part_tokens: int = PART_TOKENS) -> tuple[DataFrame, DataFrame]:
    """((cid, sig, n, least, prefix, toks) of the distinct sets that can link at
    all, (sig, rep) of the sets that several rows have)."""
    multi = stored(sets.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k"))
                   .where("k > 1").select("sig", "rep"), "equal-sets")
    copies = stored(sets.join(broadcast_if_small(multi, BROADCAST_ROWS), "sig").where(~F.col("rep").eqNullSafe(F.col("doc_id")))
                    .select(F.col("doc_id").alias("_i"), F.col("x").alias("_x")).distinct(), "copies")
    small = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = rows.join(F.broadcast(copies) if small else copies,
                    rows["doc_id"].eqNullSafe(F.col("_i")) & (rows["x"] == F.col("_x")), "left_anti")
    if not small:  # a retried task must meet the rows in the same order
        own = own.sortWithinPartitions("doc_id", "x", "t")
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // part_tokens))
    tasks = _tasks(rows)
    sent = own.select("t").mapInArrow(tidy(_send(parts, heavy_docs, block_docs)), "part int, block bigint, kind int, data binary")
    back = sent.repartition(tasks, "part").sortWithinPartitions("part", "kind", "block").mapInArrow(
        tidy(lambda b: _receive(b, parts, heavy_docs)), "block bigint, kind int, data binary")
    cand = back.repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(
        tidy(_candidates()), "sig string, n bigint, least bigint, prefix int, toks array<bigint>")
    # The number is fixed once written: later joins carry it instead of the signature.
    cand = stored(cand.withColumn("cid", F.monotonically_increasing_id()), "candidates")
    if cand.groupBy("sig").count().where("count > 1").limit(1).count():  # repeated rows
        cand = stored(cand.dropDuplicates(["sig"]), "candidates")
    return cand, multi


def _linked(o: str, n1: str, n2: str) -> str:
    return f"100 * {o} >= {PERCENT} * ({n1} + {n2} - {o})"


def _possible(o: str, n1: str, n2: str) -> str:
    """An overlap of at most ``o`` may still link sets of ``n1`` and ``n2`` shingles."""
    return f"({_linked(o, n1, n2)} and 100 * least({n1}, {n2}) >= {PERCENT} * greatest({n1}, {n2}))"


def _verified(pairs: DataFrame, cand: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` that link, compared set by set."""
    one = cand.select(F.col("cid").alias("u"), F.col("n").alias("un"), F.col("toks").alias("ut"))
    two = cand.select(F.col("cid").alias("v"), F.col("n").alias("vn"), F.col("toks").alias("vt"))
    met = pairs.join(one, "u").join(two, "v").withColumn("o", F.expr("size(array_intersect(ut, vt))"))
    return met.where(_linked("o", "un", "vn")).select("u", "v")


def groups(cand: DataFrame, members: int = PART, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((cid, grp, size, part) of every candidate, the (u, v) links that made the groups).

    In each round the candidates with the same smallest shingle under the round's
    hash meet one of them: the one with the largest share of shared shingles,
    which in a family of edited copies is the text nearest to the original.
    Candidates linked in a round are done; the links' components are the groups."""
    keys = [F.expr(f"array_min(transform(toks, t -> xxhash64(t, {r})))").alias(f"k{r}") for r in range(rounds)]
    small = stored(cand.select("cid", "n", F.size("toks").alias("sh"), *keys), "least-shingles")
    left, star = small, None
    for r in range(rounds):
        best = F.max(F.struct((F.col("sh") / F.col("n")).alias("share"), (-F.col("cid")).alias("c")))
        pivot = small.groupBy(f"k{r}").agg(best.alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1") \
            .select(f"k{r}", (-F.col("b.c")).alias("v"))
        size = small.select(F.col("cid").alias("v"), F.col("n").alias("vn"), F.col("sh").alias("vs"))
        pairs = left.join(pivot, f"k{r}").where("cid <> v").join(size, "v") \
            .where(_possible("least(sh, vs)", "n", "vn")).select(F.col("cid").alias("u"), "v")
        found = stored(_verified(pairs, cand), "group-links")
        star = found if star is None else star.unionByName(found)
        left = stored(left.join(found.select(F.col("u").alias("cid")).distinct(), "cid", "left_anti"), "ungrouped")
    root = components(star).select(F.col("node").alias("cid"), "root")
    member = small.select("cid").join(root, "cid", "left").select("cid", F.coalesce("root", "cid").alias("grp"))
    size = member.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = member.join(size, "grp", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    part = F.expr(f"cast(pmod(xxhash64(cid), cast(ceil(size / {members}D) as bigint)) as int)")
    return stored(member.select("cid", "grp", "size", part.alias("part")), "members"), star


def foreign_links(cand: DataFrame, member: DataFrame) -> DataFrame:
    """(u, v): links between candidates of different groups, by the matrix.

    The members of the smaller group ask the larger one.  A cell knows how many
    shingles of its row are at or behind it, so the first shingle that two sets
    share bounds their overlap; the matrix keeps the best such number and the
    range of sizes of a group's members for each column."""
    cells = cand.select("cid", "n", F.size("toks").alias("sh"),
                        F.posexplode(F.expr("slice(toks, 1, prefix)")).alias("k", "tok")).join(member, "cid")
    cells = stored(cells.select("tok", "cid", "grp", "size", "part", "n", (F.col("sh") - F.col("k")).alias("rest")), "cells")
    # Columns that only one group has open nothing.
    shared = cells.groupBy("tok").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).where("a <> b").select("tok")
    cells = stored(cells.join(shared, "tok", "left_semi"), "shared-cells")
    matrix = cells.groupBy("tok", F.col("grp").alias("g"), F.col("part").alias("p")).agg(
        F.first("size").alias("gsize"), F.max("rest").alias("grest"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    # The member of n0..n1 shingles nearest to n is the easiest to link with.
    able = f"100 * least(rest, grest) >= {PERCENT} * (n + n0 - least(rest, grest))" \
           f" and 100 * n >= {PERCENT} * n0 and 100 * n1 >= {PERCENT} * n"
    meets = cells.join(matrix, "tok").where(f"(size < gsize or (size = gsize and grp < g)) and {able}")
    meets = stored(meets.select("cid", "g", "p").distinct(), "meets")
    query = cand.select("cid", F.col("n").alias("qn"), F.col("toks").alias("qt"))
    inside = member.select(F.col("cid").alias("v"), F.col("grp").alias("g"), F.col("part").alias("p"))
    opened = inside.join(meets.select("g", "p").distinct(), ["g", "p"], "left_semi") \
        .join(cand.select(F.col("cid").alias("v"), "n", "toks"), "v")
    # One part has at most about PART members, so its union is bounded.
    union = opened.groupBy("g", "p").agg(F.array_distinct(F.flatten(F.collect_list("toks"))).alias("gt"), F.min("n").alias("n0"))
    bound = meets.join(query, "cid").join(union, ["g", "p"]).withColumn("o", F.expr("size(array_intersect(qt, gt))")) \
        .where(f"100 * o >= {PERCENT} * qn and {_linked('o', 'qn', 'n0')}").select("cid", "g", "p")
    bound = stored(bound, "opened")
    sized = small_sizes(cand)
    pairs = bound.join(inside, ["g", "p"]).select(F.col("cid").alias("u"), "v").distinct()
    pairs = pairs.join(sized.select(F.col("cid").alias("u"), F.col("n").alias("un"), F.col("sh").alias("us")), "u") \
        .join(sized.select(F.col("cid").alias("v"), F.col("n").alias("vn"), F.col("sh").alias("vs")), "v") \
        .where(_possible("least(us, vs)", "un", "vn")).select("u", "v")
    return stored(_verified(pairs, cand), "foreign-links")


def small_sizes(cand: DataFrame) -> DataFrame:
    return cand.select("cid", "n", F.size("toks").alias("sh"))


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the smallest node.

    Large-star and small-star contractions until nothing changes: a number of
    rounds that grows with the logarithm of a component's size."""
    e = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    for _ in range(rounds):
        mark = tuple(e.agg(F.count(F.lit(1)), F.expr("sum(cast(pmod(xxhash64(u, v), 1000000007) as decimal(38,0)))")).first())
        if mark == last or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        last = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.where("u <> v"), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components still change after {rounds} rounds")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_docs: int = HEAVY,
                      block_docs: int = BLOCK_DOCS, part_tokens: int = PART_TOKENS,
                      members: int = PART) -> DataFrame:
    """(doc_id, x, n_shingles, component_id) for every row of ``docs``; x is the
    64-bit hash of its text.  The sizes change how the work is cut, not the result."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("x"), text.alias("t"))
    sets = stored(signatures(rows), "sets")
    cand, multi = candidates(rows, sets, heavy_docs, block_docs, part_tokens)
    member, star = groups(cand, members)
    roots = components(star.unionByName(foreign_links(cand, member)))
    named = stored(roots.join(cand.select(F.col("cid").alias("node"), "sig"), "node").select("sig", "root"), "roots")
    # The smallest id of a component, over all rows of its sets.
    smallest = sets.join(broadcast_if_small(named, BROADCAST_ROWS), "sig").groupBy("root").agg(F.min("doc_id").alias("c"))
    label = named.join(smallest, "root").select("sig", "c").unionByName(
        multi.join(named, "sig", "left_anti").select("sig", F.col("rep").alias("c")))
    label = broadcast_if_small(stored(label, "labels"), BROADCAST_ROWS)
    return sets.join(label, "sig", "left").select(
        "doc_id", "x", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest id of every component, columns
    unchanged, and one of rows that repeat its id and text; the dropped ids are broadcast
    while their number is proven small."""
    found = similar_documents(docs, id_col, text_col)
    named = stored(found.groupBy(F.col("doc_id").alias("i"), "x")
                   .agg(F.max(F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
                        F.count(F.lit(1)).alias("n")).where("not kept or n > 1"), "similar")
    text = F.xxhash64(F.coalesce(F.col(f"in.{text_col}"), F.lit("")))
    return without_copies(docs, text, named.where("not kept"), named.where("kept"), id_col)
