"""Conversation structure repair with a survivor-coalescence Viterbi search.

A conversation is well formed when the initials of its roles read
``(s?(ua)+)?``: an optional system row, then user and assistant in turn, or
nothing at all.  The search runs over the four states of that pattern (nothing
yet, after ``s``, after ``u``, after ``a``).  For every row each state keeps one
survivor, the cheapest edits that end there; ties go to the ASCII-least string of
edit initials.  Survivors are leaves of a tree of back pointers whose nodes count
their references.  A node without references is freed; as soon as the root has one
child left, all survivors agree on that step and it is emitted.  What is held in
memory is the unresolved part alone.

Two survivors hold the same number of row edits and end in one, so none is a proper
prefix of another: their order as strings never changes by what follows, and the
rank of each among the survivors stands for the comparison of the complete
unresolved strings.  A survivor is dropped early only when its cost plus the least
it could still pay is above that of another one by the same future, strictly, so
ties are kept.

The rows are damaged, ordered and judged by Spark (joins and windows); the search
is a stream over the narrow rows of a conversation in order, and the SHA-256 of the
repaired rows is a second stream, because the edits of a row may be settled long
after it has passed.  Neither holds a conversation's texts.  One conversation is read
in order by one task in either stream: both the search and the hash are sequential
by nature.

Cases: a null id, turn, role or text counts as one space where text is made of it
(the damage key, the role, the text); null ids form one conversation; null turns come
first.  An empty role counts as one space.  Rows of equal turn are ordered by role,
then text (equal rows are interchangeable).  Repeated rows are faults of kind
duplicate.  A conversation that loses every row gives zeros, an empty audit and the
hash of the empty string; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ARROW_ROWS, stored, tidy

# Costs of the edits (fixed values of the task).
REROLE = 3
DELETE = 4
INSERT = 3
KEEP_TRUNCATED = 3

# States of (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
MADE = {0: "u", 1: "u", 2: "a", 3: "u"}       # the one role that may be inserted in a state
FULL = {"u": "user", "a": "assistant"}
# Inserts worth making before the next row (a third one would return to a state).
INSERTS = {s: [("", s, "")] for s in range(4)}
for _s in range(4):
    _one = STEP[_s, MADE[_s]]
    INSERTS[_s].append(("I", _one, MADE[_s]))
    if _s < 2:
        INSERTS[_s].append(("II", STEP[_one, MADE[_one]], MADE[_s] + MADE[_one]))

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
OUT_ROWS = 5_000


class Survivors:
    """The search over one conversation.  ``step`` takes a row, ``finish`` ends it;
    both return the pieces settled meanwhile, oldest first: (edits before and of the
    row, roles made by inserts and reroles)."""

    def __init__(self):
        self.parent, self.piece, self.refs, self.kids = {0: None}, {0: None}, {0: 1}, {0: 0}
        self.root, self.next = 0, 1
        self.alive = {0: (0, 0, 0)}          # state: cost, rank, node

    def _grow(self, parent, piece):
        node = self.next
        self.next += 1
        self.parent[node], self.piece[node], self.refs[node], self.kids[node] = parent, piece, 1, 0
        self.refs[parent] += 1
        self.kids[parent] ^= node            # the one child, while there is one
        return node

    def _release(self, node):
        self.refs[node] -= 1
        while not self.refs[node] and node != self.root:
            parent = self.parent.pop(node)
            del self.piece[node], self.refs[node], self.kids[node]
            self.kids[parent] ^= node
            self.refs[parent] -= 1
            node = parent

    def _settled(self):
        out = []
        while self.refs[self.root] == 1 and self.kids[self.root]:
            old, self.root = self.root, self.kids[self.root]
            del self.parent[old], self.piece[old], self.refs[old], self.kids[old]
            out.append(self.piece[self.root])
            self.parent[self.root] = None
        return out

    def step(self, initial: str, fault: int):
        best: dict[int, tuple] = {}
        late = KEEP_TRUNCATED if fault == TRUNCATED else 0
        for state, (cost, rank, node) in self.alive.items():
            for before, at, made in INSERTS[state]:
                paid = cost + INSERT * len(before)
                options = [(paid + DELETE, "D", at, "")]
                if fault not in (BLANK, DUPLICATE):
                    if (at, initial) in STEP:
                        options.append((paid + late, "K", STEP[at, initial], ""))
                    options.append((paid + REROLE + late, "R", STEP[at, MADE[at]], MADE[at]))
                for total, edit, to, role in options:
                    key = (total, rank, before + edit)
                    if to not in best or key < best[to][0]:
                        best[to] = (key, node, made + role)
        two, three = (best[s][0][0] if s in best else float("inf") for s in (2, 3))
        for state, slack in ((0, min(three + DELETE, two + INSERT + DELETE)), (1, min(three, two + INSERT))):
            if state in best and best[state][0][0] > slack:
                del best[state]
        old = [node for _, _, node in self.alive.values()]
        order = sorted(best, key=lambda s: best[s][0][1:])
        self.alive = {s: (best[s][0][0], rank, self._grow(best[s][1], (best[s][0][2], best[s][2])))
                      for rank, s in enumerate(order)}
        for node in old:
            self._release(node)
        return self._settled()

    def finish(self):
        """(cost, the remaining pieces with the last inserts as a piece of their own)."""
        tails = {0: (0, "", ""), 1: (2 * INSERT, "II", "ua"), 2: (INSERT, "I", "a"), 3: (0, "", "")}
        cost, _, tail, node, made = min((c + tails[s][0], rank, tails[s][1], node, tails[s][2])
                                        for s, (c, rank, node) in self.alive.items())
        left = []
        while node != self.root:
            left.append(self.piece[node])
            node = self.parent[node]
        return cost, [*reversed(left), (tail, made)]


def damage(rows: DataFrame) -> DataFrame:
    """The damaged rows: conv_id, turn, role and text (neither of them null)."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", shown[2].alias("role"), shown[3].alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with their place in the conversation (from 1), stored once."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return stored(rows.withColumn("place", F.row_number().over(w).cast("long")), "conversations")


def judged(rows: DataFrame) -> DataFrame:
    """The narrow rows of the search: conv_id, place, turn, initial and first fault.
    A row is a duplicate when its role and text have a smaller place somewhere; the
    smallest places are aggregated and joined, so a text that fills a conversation
    meets in no single task."""
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    text: Column = F.col("text")
    narrow = rows.select(
        "conv_id", "place", "turn",
        F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)).alias("initial"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
        F.unhex(F.sha2(said.cast("binary"), 256)).alias("said"))
    first = narrow.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min("place").alias("first"))
    fault = (F.when(F.col("blank"), BLANK).when(F.col("place") > F.col("first"), DUPLICATE)
             .when(F.col("open"), TRUNCATED).otherwise(0))
    return (narrow.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
            .select("conv_id", "place", "turn", "initial", fault.alias("fault")))


class _Conversation:
    """Counts and search of the conversation that passes."""

    def __init__(self, conv):
        self.conv, self.search, self.rows, self.out = conv, Survivors(), 0, 0
        self.low = self.high = self.turn = self.last = None
        self.turns, self.counts = 0, {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.illegal = 0

    def add(self, turn, initial, fault):
        if turn is not None and (self.high is None or turn != self.high):
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if fault:
            self.counts[fault] += 1
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        return self._numbered(self.search.step(initial, fault))

    def _numbered(self, pieces):
        rows = []
        for edits, made in pieces:
            self.out += 1
            rows.append((self.conv, self.out, edits, made, None))
        return rows

    def end(self):
        cost, pieces = self.search.finish()
        *rows, (conv, place, edits, made, _) = self._numbered(pieces)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        told = {"gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE],
                "truncated": self.counts[TRUNCATED], "illegal": self.illegal, "cost": cost}
        return [*rows, (conv, place, edits, made, told)]


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
TOLD = pa.struct([(c, pa.int64()) for c in COUNTS])
TOLD_SQL = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def search_edits(narrow: DataFrame) -> DataFrame:
    """conv_id, place, edits (of the row, with the inserts before it), made (the
    roles made by inserts and reroles) and, on the row after the last one, told (the
    counts and the cost)."""
    kind = narrow.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, waiting, id_type = None, [], None

        def batch(rows):
            cols = list(zip(*rows))
            types = (id_type, pa.int64(), pa.string(), pa.string(), TOLD)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              ["conv_id", "place", "edits", "made", "told"])

        for b in batches:
            id_type = b.schema.field("conv_id").type
            for conv, turn, initial, fault in zip(*(b.column(b.schema.get_field_index(c)).to_pylist()
                                                    for c in ("conv_id", "turn", "initial", "fault"))):
                if now is None or conv != now.conv:
                    if now is not None:
                        waiting += now.end()
                    now = _Conversation(conv)
                waiting += now.add(turn, initial, fault)
                if len(waiting) >= OUT_ROWS:
                    yield batch(waiting)
                    waiting = []
        if now is not None:
            waiting += now.end()
        if waiting:
            yield batch(waiting)

    placed = narrow.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "place")
    return placed.mapInArrow(tidy(run), f"conv_id {kind}, place long, edits string, made string, told {TOLD_SQL}")


def repaired_lines(edits: str, made: str, role, text):
    """The (role, text) rows that a piece of edits leaves."""
    roles = iter(made)
    for e in edits:
        if e == "I":
            yield FULL[next(roles)], ""
        elif e == "R":
            yield FULL[next(roles)], text
        elif e == "K":
            yield role, text


def _with_texts(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits and rows of each conversation as one ordered stream: at every place
    the edits, then the row."""
    return (edits.select("conv_id", "place", F.lit(0).alias("part"), "edits", "made", "told",
                         F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
            .unionByName(rows.select("conv_id", "place", F.lit(1).alias("part"), "role", "text"),
                         allowMissingColumns=True)
            .repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "place", "part"))


def _stream_lines(batches):
    """(conv, edits, lines, told) of every place; the last place of a conversation
    has told."""
    edits = made = told = None
    for b in batches:
        names = ("conv_id", "part", "edits", "made", "told", "role", "text")
        for conv, part, e, m, t, role, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist()
                                                     for c in names)):
            if part == 0:
                edits, made, told = e, m, t
                if told is not None:
                    yield conv, edits, repaired_lines(edits, made, None, None), told
            else:
                yield conv, edits, repaired_lines(edits, made, role, text), None


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """The damaged conversations repaired: conv_id, line (from 1), role, text."""
    rows = ordered(damage(conversations))
    kind = rows.schema["conv_id"].dataType.simpleString()
    stream = _with_texts(rows, search_edits(judged(rows)))

    def run(batches):
        line, out, id_type = 0, [], None

        def typed():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("conv_id").type
                yield b

        def batch():
            types = (id_type, pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                              ["conv_id", "line", "role", "text"])

        for conv, _, lines, told in _stream_lines(typed()):
            for role, text in lines:
                line += 1
                out.append((conv, line, role, text))
            if told is not None:
                line = 0
            if len(out) >= ARROW_ROWS:
                yield batch()
                out = []
        if out:
            yield batch()

    return stream.mapInArrow(tidy(run), f"conv_id {kind}, line long, role string, text string")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the input: the counts of its damaged rows, the cost,
    the audit (edit initials) and the SHA-256 of the repaired rows."""
    rows = ordered(damage(conversations))
    kind = rows.schema["conv_id"].dataType.simpleString()
    stream = _with_texts(rows, search_edits(judged(rows)))

    def run(batches):
        audit, digest, first, out, id_type = [], hashlib.sha256(), True, [], None

        def typed():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("conv_id").type
                yield b

        def batch():
            cols = list(zip(*out))
            types = (id_type, TOLD, pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              ["c", "told", "audit", "repaired_sha256"])

        for conv, edits, lines, told in _stream_lines(typed()):
            audit.append(edits)
            for role, text in lines:
                digest.update((("" if first else "\n") + f"{role}:{text}").encode())
                first = False
            if told is not None:
                out.append((conv, told, "".join(audit), digest.hexdigest()))
                audit, digest, first = [], hashlib.sha256(), True
                if len(out) >= OUT_ROWS:
                    yield batch()
                    out = []
        if out:
            yield batch()

    found = stream.mapInArrow(tidy(run), f"c {kind}, told {TOLD_SQL}, audit string, repaired_sha256 string")
    every = conversations.select("conv_id").distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *[F.coalesce(F.col(f"told.{c}"), F.lit(0).cast("long")).alias(c) for c in COUNTS[:5]],
        F.coalesce(F.col("told.cost"), F.lit(0).cast("long")).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
