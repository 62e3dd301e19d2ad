import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from pressgrid.llm import conversations as C
from pressgrid.llm.queries import LLM_QUERIES

ACCEPT = re.compile(r"(s?(ua)+)?\Z")
WS = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    """Rows (conv, turn, role, text) after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        show = [" " if v is None else str(v) for v in (conv, turn)]
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(show).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(WS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen
                   else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows, initial=lambda r: r[:1] or " "):
    """Cheapest edits by trying every edit at every place from the end backwards,
    comparing whole strings."""
    bad = faults(rows)
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, at, inserts):
        found = []
        if i == len(rows) and at in ("", "a"):
            found.append((0, "", ()))
        if inserts < 4:
            for r, name in (("u", "user"), ("a", "assistant")):
                if (at, r) in after:
                    c, audit, lines = best(i, after[at, r], inserts + 1)
                    found.append((c + 3, "I" + audit, (f"{name}:", *lines)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, audit, lines = best(i + 1, at, 0)
            found.append((c + 4, "D" + audit, lines))
            if bad[i] not in ("blank", "duplicate"):
                late = 3 * (bad[i] == "truncated")
                to = after.get((at, initial(role)))
                if to:
                    c, audit, lines = best(i + 1, to, 0)
                    found.append((c + late, "K" + audit, (f"{role}:{text}", *lines)))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (at, r) in after:
                        c, audit, lines = best(i + 1, after[at, r], 0)
                        found.append((c + 3 + late, "R" + audit, (f"{name}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = damaged([r for r in rows if r[0] == conv])
        bad = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        heads = [r[2][:1] or " " for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
        cost, audit, lines = brute(mine)
        out.append((conv, gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost,
                    audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, place long, c string, kind int, told string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)


def test_random_conversations_equal_brute_force(spark):
    r = random.Random(7)
    rows = []
    for conv in range(150):
        for turn in range(r.randrange(0, 9)):
            rows.append((conv, turn + 3 * (r.random() < 0.1), r.choice(["user", "assistant", "user", "system", "tool"]),
                         r.choice(["Yes.", "no", " ", "", "What? ", "One! two", "same.", "ß…\n"])))
    assert got(C.repair_digest(frame(spark, rows))) == expected(rows)


def test_awkward_rows(spark):
    rows = [(1, None, "user", "a."), (1, None, "assistant", "b."), (1, 2, None, "c."), (1, 2, "", None),
            (None, 1, "user", "x"), (None, None, "user", "x"), (2, 5, "user", "Hi." * 50_000),
            (2, 6, "assistant", "Yo."), (2, 6, "assistant", "Yo."), (2, 6, "assistant", "Yo."),
            (3, 2**62, "user", "far."), (-4, -1, "umpire", "Out!"), (-4, 0, "a", "Safe?")]
    assert got(C.repair_digest(frame(spark, rows))) == expected(rows)
    assert C.repair_digest(frame(spark, rows).limit(0)).collect() == []


def test_conversation_that_loses_every_row(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(C.repair_digest(frame(spark, [(lost, 0, "user", "a.")]))) == [
        (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert got(LLM_QUERIES["op13_conversation_repair"](spark, sf)) == expected(rows)


def test_repaired_rows_are_well_formed(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    out = {}
    for r in sorted(C.repaired_rows(frame(spark, rows)).collect(), key=lambda r: (r.conv_id, r.line)):
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(ACCEPT.match("".join(role[0] for role, _ in lines)) for lines in out.values())
    hashes = {e[0]: e[-1] for e in expected(rows)}
    for conv, lines in out.items():
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest() == hashes[conv]


@pytest.mark.parametrize("roles", ["ua", "sua", "uaua ua", "uat"])
def test_memory_stays_bounded_where_survivors_agree(roles):
    search, held, out = C.Survivors(), 0, 0
    for i in range(30_000):
        out += len(search.step(roles[i % len(roles)], 0))
        held = max(held, len(search.parent))
    assert held <= 60
    assert out + len(search.finish()[1]) == 30_001


def test_long_unresolved_ties(spark):
    rows = [(1, t, "user", f"{t}.") for t in range(150)]
    assert got(C.repair_digest(frame(spark, rows))) == expected(rows)
    search, out = C.Survivors(), []
    for _ in range(20_000):
        out += search.step("u", 0)
    assert len(search.parent) > 20_000      # two readings stay possible to the end
    cost, left = search.finish()
    assert cost == 30_000 and "".join(p for p, _ in [*out, *left]) == "KR" * 10_000
