"""SentencePiece encoding and decoding with a max-plus scan over giant documents.

A BPE encoding is the one path of pieces over the text in which every two
neighbours are *compatible*: encoding the two together gives the two back.  So
encoding is a best-path problem: a compatible step scores 0, any other minus
infinity, and exactly one path scores 0.  That makes it a max-plus product and
lets a giant document be cut anywhere:

* a state at a cut is the piece that covers the character before it (its start
  and end relative to the cut), so a cut has at most a few dozen states;
* every chunk, on its own, yields the transfer matrix from the states at its
  left cut to those at its right cut;
* the matrices of a document are combined with the associative max-plus
  product, which fixes the state at every cut;
* each chunk is then backtraced independently between its two states.

Inside a chunk, the dynamic programme runs only up to the first and from the
last *safe* place, a space after another character: no piece of the vocabulary
holds a space after another character, so every path passes there, and the
library's own encoding is the path between them.  A chunk without a safe place
is solved by the dynamic programme throughout.

Documents of at most ``CHUNK`` characters are one chunk, encoded by the library.

Cases: a null or empty text has no ids and decodes to the empty text; characters
outside the vocabulary become byte pieces, as in the library; a text with the
mark U+2581 decodes with spaces in its place (``round_trip`` is false); equal
ids or repeated rows are kept apart by a row key; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, small_batches, stored, tidy

CHUNK = 32_768
AT_ONCE = 500_000  # characters whose ids are Python integers at one time
SPACE = "▁"
NEG = -np.inf


class Pieces:
    """The vocabulary of a SentencePiece BPE model and its compatibility rule."""

    def __init__(self, path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.sp
        plain = [i for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.longest = max(map(len, self.rank))
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # The scan's safe places rest on this property of the vocabulary.
        self.safe_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self._pair: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """BPE of a short string by its rule: join the neighbours whose union has
        the best score, leftmost first, until none is in the vocabulary."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.rank.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        key = left, right
        if key not in self._pair:
            if len(self._pair) > 500_000:
                self._pair.clear()
            self._pair[key] = self.merge(left + right) == [left, right]
        return self._pair[key]

    def alone(self, piece: str) -> bool:
        return self.merge(piece) == [piece]

    def starting(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that begin at ``at``; a single character always is one."""
        return [at + n for n in range(1, min(self.longest, len(text) - at) + 1)
                if n == 1 or text[at:at + n] in self.rank]

    def to_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]


def normalise(text: str) -> str:
    """What the library segments: spaces as marks, one mark in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def states_at(v: Pieces, text: str, cut: int) -> list[tuple[int, int]]:
    """(start, end) of every piece that covers the character before ``cut``."""
    return [(s, e) for s in range(max(0, cut - v.longest), cut) for e in v.starting(text, s) if e >= cut]


def _safe(text: str, start: int, end: int) -> tuple[int, int]:
    """The first and last safe place in (start, end), or (-1, -1)."""
    first = last = -1
    at = text.find(SPACE, start + 1, end)
    while at >= 0:
        if text[at - 1] != SPACE:
            first = at
            break
        at = text.find(SPACE, at + 1, end)
    if first < 0:
        return -1, -1
    at = text.rfind(SPACE, start + 1, end)
    while at >= 0:
        if text[at - 1] != SPACE:
            last = at
            break
        at = text.rfind(SPACE, start + 1, at)
    return first, last


def _paths(v: Pieces, text: str, source: tuple[int, int], stop: int) -> dict:
    """Back pointers {piece: previous piece} of all score-0 paths from piece
    ``source`` over the pieces that begin before ``stop``."""
    back, todo = {source: None}, {source[1]: [source]}
    for at in range(source[1], stop):
        for prev in todo.pop(at, ()):
            for e in v.starting(text, at):
                nxt = (at, e)
                if nxt not in back and v.compatible(text[prev[0]:prev[1]], text[at:e]):
                    back[nxt] = prev
                    todo.setdefault(e, []).append(nxt)
                elif nxt in back and back[nxt] != prev and v.compatible(text[prev[0]:prev[1]], text[at:e]):
                    # Two score-0 ways to the same piece from one source cannot
                    # both be valid encodings of the same stretch.
                    raise AssertionError("two encodings of one stretch")
    return back


def _trace(back: dict, last: tuple[int, int]) -> list[tuple[int, int]]:
    out = []
    while last is not None:
        out.append(last)
        last = back[last]
    return out[::-1]


class Chunk:
    """One chunk of a normalised text: ``text`` holds it with a halo of the
    longest piece on either side; ``a`` and ``b`` are its cuts inside ``text``.

    ``first``/``last`` say whether the text begins/ends with the document."""

    def __init__(self, v: Pieces, text: str, a: int, b: int, first: bool, last: bool):
        self.v, self.text, self.a, self.b = v, text, a, b
        # The document's beginning is one state: nothing in front.
        self.left = [(0, 0)] if first else states_at(v, text, a)
        self.right = [(len(text), len(text))] if last else states_at(v, text, b)
        self.last = last
        self.safe = _safe(text, a, b) if v.safe_spaces else (-1, -1)

    def _steps(self, source: tuple[int, int], stop: int) -> dict:
        if source == (0, 0):  # the document's beginning: any piece may come first
            back: dict = {}
            for e in self.v.starting(self.text, 0):
                if self.v.alone(self.text[:e]):
                    back.update({k: p for k, p in _paths(self.v, self.text, (0, e), stop).items() if k not in back})
            return back
        return _paths(self.v, self.text, source, stop)

    def _arrivals(self, back: dict, at: int) -> list[tuple[int, int]]:
        return [p for p in back if p[1] == at]

    def _matrix(self) -> np.ndarray:
        m = np.full((len(self.left), len(self.right)), NEG)
        p, q = self.safe
        if p < 0:
            for i, s in enumerate(self.left):
                back = self._steps(s, self.b)
                for j, t in enumerate(self.right):
                    if (t in back) if not self.last else bool(self._arrivals(back, self.b)) or s[1] == self.b > 0:
                        m[i, j] = 0.0
            return m
        # All paths meet at the safe places p and q, so the matrix is the outer
        # sum of "reaches p" and "reached from q".
        reach = [0.0 if s[1] <= p and (self._arrivals(self._steps(s, p), p) or s[1] == p) else NEG for s in self.left]
        leave = []
        tails = self._from_safe(q)
        for t in self.right:
            ok = t in tails if not self.last else bool(self._arrivals(tails, self.b))
            leave.append(0.0 if ok else NEG)
        return np.add.outer(np.array(reach), np.array(leave))

    def _from_safe(self, q: int) -> dict:
        """Back pointers of the paths that begin exactly at the safe place ``q``."""
        back: dict = {}
        for e in self.v.starting(self.text, q):
            if self.v.alone(self.text[q:e]):
                back.update({k: p for k, p in _paths(self.v, self.text, (q, e), self.b).items() if k not in back})
        return back

    def transfer(self) -> np.ndarray:
        """The chunk's max-plus matrix: left states by right states."""
        return self._matrix()

    def trace(self, i: int, j: int) -> list[int]:
        """Ids of the pieces that begin inside the chunk, between state ``i`` at
        its left cut and state ``j`` at its right cut."""
        s, t = self.left[i], self.right[j]
        p, q = self.safe
        inside: list = []

        def begun(path):
            return [x for x in path if x[1] > x[0] and self.a <= x[0] < self.b]

        def ids(path):
            return [k for x in path for k in self.v.to_ids(self.text[x[0]:x[1]])]

        if p < 0:
            back = self._steps(s, self.b)
            end = t if not self.last else next(iter(self._arrivals(back, self.b)), s)
            return ids(begun(_trace(back, end)))
        if s[1] < p or s == (0, 0):
            back = self._steps(s, p)
            inside += ids(begun(_trace(back, self._arrivals(back, p)[0])))
        if q > p:
            # The middle begins with the mark the library would put in front.
            inside += self.v.sp.encode(self.text[p + 1:q])if q > p + 1 else ids([(p, q)])
        tails = self._from_safe(q)
        end = t if not self.last else self._arrivals(tails, self.b)[0]
        return inside + ids(begun(_trace(tails, end)))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(1)


def resolve(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(left state, right state) of every chunk on the best path, from the
    suffix products and one forward walk."""
    suffix = [matrices[-1]]
    for m in reversed(matrices[:-1]):
        suffix.append(combine(m, suffix[-1]))
    suffix.reverse()
    if suffix[0].max() == NEG:
        raise ValueError("no segmentation")
    out, state = [], int(suffix[0].max(1).argmax())
    for k, m in enumerate(matrices):
        after = suffix[k + 1].max(1) if k + 1 < len(matrices) else np.zeros(m.shape[1])
        nxt = int((m[state] + after).argmax())
        out.append((state, nxt))
        state = nxt
    return out


def cut(v: Pieces, text: str, size: int) -> list[tuple[str, int, int, bool, bool]]:
    """The chunks of a normalised text with their halos."""
    out = []
    for a in range(0, len(text), size):
        b = min(len(text), a + size)
        lo, hi = max(0, a - v.longest), min(len(text), b + v.longest)
        out.append((text[lo:hi], a - lo, b - lo, a == 0, b == len(text)))
    return out


_models: dict = {}  # one per worker process


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _pack(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def encode(docs: DataFrame, path: str, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``docs`` plus ``pieces``: the ids as little-endian unsigned 32-bit integers.

    Short texts are encoded where they are.  Only the chunks of giant ones move:
    they are spread over the tasks, their matrices meet per document (a bounded
    share of the document itself), and the traced chunks join the document's row.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("pieces")
    key = free_name(docs, "_row")
    text_len = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    giant = text_len > chunk
    columns, place = docs.columns, docs.columns.index(text_col)
    schema = docs.withColumn("pieces", F.lit(b"")).schema

    def short(batches):
        v = model(path)
        for b in batches:
            texts = [t or "" for t in b.column(place).to_pylist()]
            got = [_pack(i) for s, e in slices(texts, AT_ONCE) for i in v.sp.encode(texts[s:e], num_threads=1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*columns, "pieces"])

    small = docs.where(~giant).mapInArrow(tidy(short), schema)
    big = docs.where(giant)
    # Rows of equal text share their chunks: the key is the text's own hash.
    text_key = F.sha2(F.col(text_col), 256)
    ids = stored(big.select(text_key.alias(key), F.col(text_col).alias("t")).dropDuplicates([key]), "giant-texts")
    return small.unionByName(_scan(ids, key, path, chunk).join(
        big.withColumn(key, text_key), key).select(*columns, "pieces"))


def _scan(texts: DataFrame, key: str, path: str, chunk: int) -> DataFrame:
    """(key, pieces) of giant texts by the chunk scan."""

    def chunks(batches):
        v = model(path)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = cut(v, normalise(t), chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(parts)), pa.array(range(len(parts)), pa.int32()),
                     *(pa.array(list(c)) for c in zip(*parts))], ["k", "n", "text", "a", "b", "first", "last"])

    shape = "k string, n int, text string, a bigint, b bigint, first boolean, last boolean"
    parts = texts.select(key, "t").mapInArrow(tidy(chunks), shape)
    spread = max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    parts = stored(parts.repartition(spread, "k", "n"), "giant-chunks")

    def transfers(batches):
        v = model(path)
        for b in batches:
            rows = b.to_pylist()
            got = [Chunk(v, r["text"], r["a"], r["b"], r["first"], r["last"]).transfer() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["k"] for r in rows]), pa.array([r["n"] for r in rows], pa.int32()),
                 pa.array([m.shape[1] for m in got], pa.int32()),
                 pa.array([m.astype("<f4").tobytes() for m in got], pa.binary())], ["k", "n", "width", "m"])

    def boundaries(batches):
        for b in batches:
            for r in b.to_pylist():
                m = [np.frombuffer(x["m"], "<f4").reshape(-1, x["width"])
                     for x in sorted(r["ms"], key=lambda x: x["n"])]
                path_ = resolve(m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["k"]] * len(m)), pa.array(range(len(m)), pa.int32()),
                     pa.array([p[0] for p in path_], pa.int32()), pa.array([p[1] for p in path_], pa.int32())],
                    ["k", "n", "i", "j"])

    def traces(batches):
        v = model(path)
        for b in batches:
            rows = b.to_pylist()
            got = [_pack(Chunk(v, r["text"], r["a"], r["b"], r["first"], r["last"]).trace(r["i"], r["j"])) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["k"] for r in rows]),
                                              pa.array([r["n"] for r in rows], pa.int32()),
                                              pa.array(got, pa.binary())], ["k", "n", "p"])

    matrices = parts.mapInArrow(tidy(transfers), "k string, n int, width int, m binary")
    # One document's matrices are a small share of the document's own row.
    per = matrices.groupBy("k").agg(F.collect_list(F.struct("n", "width", "m")).alias("ms"))
    states = per.mapInArrow(tidy(boundaries), "k string, n int, i int, j int")
    traced = parts.join(states, ["k", "n"]).select(*parts.columns, "i", "j").mapInArrow(
        tidy(traces), "k string, n int, p binary")
    whole = traced.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "p"))).alias("ps"))
    empty = F.lit(b"")
    return whole.select(F.col("k").alias(key),
                        F.aggregate("ps", empty, lambda a, x: F.concat(a, x["p"])).alias("pieces"))


def decode(encoded: DataFrame, path: str, ids_col: str = "pieces", out: str = "decoded") -> DataFrame:
    """``encoded`` plus the text its ids stand for."""
    small_batches(encoded.sparkSession)
    encoded = encoded.drop(out)
    columns, place = encoded.columns, encoded.columns.index(ids_col)
    schema = encoded.withColumn(out, F.lit("")).schema

    def run(batches):
        v = model(path)
        for b in batches:
            # One document's integers at a time: they are far larger than its bytes.
            text = [v.sp.decode(np.frombuffer(x.as_py(), "<u4").tolist()) if x.is_valid and len(x.as_py()) else ""
                    for x in b.column(place)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*columns, out])

    return encoded.mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
               chunk: int = CHUNK) -> DataFrame:
    """(id, n_pieces, pieces_crc32, decoded_crc32, round_trip) per document:
    encoded, decoded again and compared with the text."""
    enc = encode(docs.select(id_col, text_col), path, text_col, chunk)
    dec = decode(enc, path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return dec.select(id_col, (F.octet_length("pieces") / 4).cast("long").alias("n_pieces"),
                      F.crc32("pieces").alias("pieces_crc32"),
                      F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
                      (F.col("decoded") == text).alias("round_trip"))
