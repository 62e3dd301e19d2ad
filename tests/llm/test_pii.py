import hashlib
import random
import re

from pyspark.sql import functions as F

from pressgrid.llm import pii as S

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(t):
    out = []
    for k, p in RULES.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


STATED = ["a@b.co_x@y.com 1.2.3.4.5.6.7.8 é4111 1111 1111 1111 z +1 (988) 555-2485.", "",
          "x@y.z@w.v a.b@c.d.e- +12-()3 +123456789012345678 0001.002.3.4 1.2.3.256 300.1.1.1.1",
          "4111111111111111 4111-1111-1111-1112 12 34 4111111111111111 5- 4111 1111 1111 1111-2 " + "9" * 3000,
          "a" * 50000 + "@b.c", "1 " * 30000, "😀 +44 20 7946 0958"]


def test_base_spans_equal_brute_force(spark):
    r = random.Random(3)
    texts = STATED + ["".join(r.choice("01234 .-+@aZ%_()") for _ in range(r.randrange(300))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in S.find_personal_data(df).collect():
        assert row.base_sha256 == hashlib.sha256(brute(texts[row.doc_id]).encode()).hexdigest(), texts[row.doc_id][:200]


def test_boosting_learns_and_thresholds_hold():
    table = [((6, d, 1, s, n, 0, 0, 0), 95.0 if n else 2.0, 5.0 if n else 98.0)
             for d in (1, 2) for s in (1, 2) for n in (0, 1)]
    start, trees = S.boost(table)
    score = {x: start + S.RATE * sum(S._value(t, x) for t in trees) for x, _, _ in table}
    assert min(v for x, v in score.items() if x[4]) > max(v for x, v in score.items() if not x[4])
    limit = S.thresholds(table, start, trees)[6]
    assert all((score[x] >= limit) == bool(x[4]) for x in score)
    assert S.boost([]) [1] == [] and S.thresholds([], 0.0, []) == {}


def test_named_candidates_are_added(spark):
    rows = [(i, f"call tel: 020 7946 {1000 + i} soon") for i in range(60)] + \
        [(100 + i, f"value 020 7946 {1000 + i} plain") for i in range(60)]
    out = S.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.spans for r in out.collect()}
    assert all("phone_local" in got[i] for i in range(60)) and all(got[100 + i] == "" for i in range(60))


def test_awkward_rows_and_redaction(spark, docs, none):
    out = S.find_personal_data(docs)
    assert out.count() == docs.count() and out.where("spans <> ''").count() == 0
    assert S.find_personal_data(none).count() == 0
    df = spark.createDataFrame([(1, "é me@x.org and 10.0.0.1!"), (2, None)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in S.redacted(df, S.find_personal_data(df)).collect()}
    assert clean == {1: "é [PII] and [PII]!", 2: None}


def test_no_python_in_the_plan(spark, docs):
    plan = S.spans(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert F is not None


def _wide(spark, texts, kind):
    """The matches of a generator per text."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    got = df.withColumn("m", S.matches("t", S.WIDE[kind])).orderBy("doc_id")
    return [[x.m for x in r.m] for r in got.collect()]


def test_account_numbers_of_every_length(spark):
    r = random.Random(4)
    plain = ["DE89" + "".join(r.choice("0123456789") for _ in range(n - 4)) for n in range(15, 35)]
    spaced = [" ".join(p[i:i + 4] for i in range(0, len(p), 4)) for p in plain]
    want = plain + spaced
    assert _wide(spark, [f"to {p}, now" for p in want], "iban") == [[p] for p in want]
    assert _wide(spark, ["DE8937040044", plain[0][:14], "A" + plain[3], plain[3] + "x", plain[-1] + "1"], "iban") == [[]] * 5


def test_spelled_out_addresses_whole(spark):
    want = ["jo (at) mail (dot) example (dot) com", "jo[at]mail[dot]example[dot]co[dot]uk", "j (at) mail.example.com",
            "jo (at) mail . example . com", "x" * 60 + " (at) example (dot) com", "jo (at) mail (dot) 4you (dot) photography",
            "jo (at) example. com"]
    assert _wide(spark, [f"write to {w}. Please do" for w in want], "email_spelled") == [[w] for w in want]
    long = "a" * 100000 + " (at) b" + " (dot) b" * 20000
    assert _wide(spark, ["a" * 200000, long], "email_spelled") == [[], [long]]


def test_overlaps_are_resolved_from_the_best_down(spark):
    gens = {g: s for g, s in zip(range(len(S.BASE), len(S.BASE) + 4), (4.0, 3.0, 2.0, 1.0))}
    first = min(gens)
    tree = (0, first + 1, 4.0, (0, first + 2, 3.0, (0, first + 3, 2.0, 1.0)))
    fields = ", ".join(f"'{k}', 0" for k in S.FEATURES if k != "gen")
    spans = ", ".join(f"named_struct('s', {5 * i}, 'e', {5 * i + 8}, 'gen', {g}, {fields})" for i, g in enumerate(gens))
    found = spark.sql(f"select 1L doc_id, filter(array({spans}), x -> false) base, array({spans}) wide")
    out = S.select_spans(found, 0.0, [tree], dict.fromkeys(gens, -1.0)).first().more
    # The second is beaten by the first, so the third stays, and beats the fourth.
    assert [x.gen for x in out] == [first, first + 2]
