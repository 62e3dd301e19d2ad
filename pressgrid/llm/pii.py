"""Personal data: rule findings plus gradient-boosted candidate selection, all in
DataFrame expressions.

Base findings, leftmost non-overlapping per kind (positions in code points, end
exclusive): email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone
(plus sign, 9 to 15 digits).  They always stay.

High-recall generators propose further, overlapping spans: national phone
numbers, spelled-out addresses (``at``/``dot``), social-security-like numbers,
bank account numbers and long digit groups.  Every candidate of every document,
base ones included, is described by small integer format and context features.
Boosted trees of depth two are fitted with Newton steps on the table of
distinct feature vectors (counts over all documents; its size is bounded by the
product of the feature ranges, not by the corpus).  Weak labels: a base finding,
or a candidate whose left context names its kind, is positive.  The trees become
one SQL expression.  Per generator a threshold on the score is calibrated to
``PRECISION`` on those counts; candidates above it and clear of base findings are
taken greedily by score, and each that overlaps none taken before is a finding of
its generator's kind.

The text is read once; everything after it works on the stored spans.

The patterns are written so that one match costs linear time and no recursion:
possessive repeats where nothing could be given back, and look-behinds where a
match cannot begin inside a run.

Cases: a null text counts as empty; very long texts are scanned whole; rows are
independent (repeated ids keep one row each); without candidates the model is
empty and selects nothing; an empty table gives an empty result; only the id
and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The base rules.  Digits, Luhn and part checks follow below.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Between the labels of a spelled-out domain; after the first label also a full stop
# with a space on one side, which later on would be the end of a sentence.
_DOT = r"\x20?(?:\(dot\)|\[dot\])\x20?|\.|\x20\.\x20"
WIDE = {
    "phone_local": r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
                     rf"(?:(?:{_DOT})[A-Za-z0-9-]++|\x20?\.\x20?[A-Za-z]{{2,}}+)(?:(?:{_DOT})[A-Za-z0-9-]++)*+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # 15 to 34 characters; the last group may be short.
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20?[A-Z0-9]{4}){7}(?:\x20?[A-Z0-9]{1,2})?"
            r"|(?:\x20?[A-Z0-9]{4}){3,6}(?:\x20?[A-Z0-9]{1,3})?|(?:\x20?[A-Z0-9]{4}){2}\x20?[A-Z0-9]{3})(?![A-Za-z0-9])",
    "digits": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){8,}+",
}
NAMED = r"(?i)(?:tel|phone|call|mobile|fax|mail|contact|ssn|social|iban|account|card|id)[a-z.]*[\x20:#]*$"
CONTEXT = 24
KINDS = tuple(BASE)
# Feature columns and the number of values each can take.
FEATURES = {"gen": len(BASE) + len(WIDE), "digits": 6, "length": 5, "seps": 4, "named": 2,
            "after_letter": 2, "before_letter": 2, "same": 2}
TREES, RATE, RIDGE, PRECISION = 12, 0.4, 1.0, 0.95


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str) -> Column:
    """Non-overlapping matches of ``pattern`` in column ``text`` as an array of
    (s, e, m, l, r): place, match, left context and the character after it.

    The pieces between the matches give the places."""
    p = _lit(pattern)
    return F.expr(f"""
      aggregate(array(regexp_extract_all({text}, {p}, 0)),
        cast(array() as array<struct<s:int,e:int,m:string,l:string,r:string>>),
        (none, ms) -> case when size(ms) = 0 then none else
          aggregate(array(split({text}, {p}, -1)), none, (n2, ps) ->
            aggregate(sequence(1, size(ms)),
              named_struct('at', 0, 'out', n2),
              (a, i) -> named_struct(
                'at', a.at + char_length(ps[i - 1]) + char_length(ms[i - 1]),
                'out', concat(a.out, array(named_struct(
                  's', a.at + char_length(ps[i - 1]),
                  'e', a.at + char_length(ps[i - 1]) + char_length(ms[i - 1]),
                  'm', ms[i - 1], 'l', right(ps[i - 1], {CONTEXT}), 'r', left(ps[i], 1)))))).out) end)""")


# Luhn: from the right, every second digit counts double, 9 off when above 9.
LUHN = """aggregate(sequence(1, length(d)), 0L, (a, i) -> a + case when i % 2 = 1
    then cast(substring(d, -i, 1) as int)
    else (cast(substring(d, -i, 1) as int) * 2) % 10 + cast(substring(d, -i, 1) as int) div 5 end) % 10 = 0"""


def _valid(kind: str) -> str:
    """The check of a base match ``x.m`` as SQL."""
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    if kind == "ip":
        return ("forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) < 3 "
                "or (length(ltrim('0', p)) = 3 and ltrim('0', p) <= '255'))")
    if kind == "card":
        return f"exists(array({digits}), d -> length(d) between 13 and 19 and {LUHN})"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    return "true"


def _features(gen: int) -> str:
    """The integer features of candidate ``x`` as a struct."""
    digits = "length(regexp_replace(x.m, '[^0-9]', ''))"
    return f"""named_struct('s', x.s, 'e', x.e, 'gen', {gen},
      'digits', cast(case when {digits} = 0 then 0 when {digits} < 9 then 1 when {digits} < 11 then 2
                     when {digits} < 13 then 3 when {digits} < 17 then 4 else 5 end as int),
      'length', cast(least(4, length(x.m) div 8) as int),
      'seps', cast(least(3, length(regexp_replace(x.m, '[^\\\\x20().-]', ''))) as int),
      'named', cast(rlike(x.l, {_lit(NAMED)}) as int),
      'after_letter', cast(rlike(x.l, '[A-Za-z]$') as int),
      'before_letter', cast(rlike(x.r, '[A-Za-z]') as int),
      'same', cast(rlike(x.m, '([0-9])\\\\1{{5}}') as int))"""


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, wide): valid base findings and generator candidates with their
    features, in one scan of the text."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for i, (k, p) in enumerate(BASE.items()):
        rows = rows.withColumn(f"b_{k}", matches("t", p))
        rows = rows.withColumn(f"b_{k}", F.expr(f"transform(filter(b_{k}, x -> {_valid(k)}), x -> {_features(i)})"))
    for i, (k, p) in enumerate(WIDE.items()):
        rows = rows.withColumn(f"w_{k}", matches("t", p))
        rows = rows.withColumn(f"w_{k}", F.expr(f"transform(w_{k}, x -> {_features(len(BASE) + i)})"))
    return rows.select(id_col, F.concat(*[F.col(f"b_{k}") for k in BASE]).alias("base"),
                       F.concat(*[F.col(f"w_{k}") for k in WIDE]).alias("wide"))


# ------------------------------------------------------------------- boosting

def feature_table(found: DataFrame) -> list[tuple[tuple[int, ...], float, float]]:
    """Distinct feature vectors with their positive and negative counts.

    A candidate that overlaps a base finding counts as that finding would; the
    table is bounded by the product of the feature ranges."""
    cols = list(FEATURES)
    c = found.select(F.explode(F.expr("""concat(
        transform(base, x -> named_struct('x', x, 'y', 1)),
        transform(wide, x -> named_struct('x', x, 'y', case when x.named = 1
            or exists(base, b -> b.s < x.e and x.s < b.e) then 1 else 0 end)))""")).alias("c"))
    t = c.groupBy(*[F.col(f"c.x.{k}").alias(k) for k in cols]).agg(
        F.sum("c.y").alias("pos"), F.count(F.lit(1)).alias("n"))
    return sorted((tuple(r[k] for k in cols), float(r["pos"]), float(r["n"] - r["pos"])) for r in t.collect())


def _leaf(rows: list) -> float:
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    return g / (h + RIDGE)


def _split(rows: list):
    """The best (gain, feature, cut, low, high) over ``rows`` of (x, g, h)."""
    def worth(part):
        g, h = sum(r[1] for r in part), sum(r[2] for r in part)
        return g * g / (h + RIDGE)

    best, whole = None, worth(rows)
    for f, size in enumerate(FEATURES.values()):
        for cut in range(1, size):
            low, high = [r for r in rows if r[0][f] < cut], [r for r in rows if r[0][f] >= cut]
            if low and high:
                gain = worth(low) + worth(high) - whole
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, f, cut, low, high)
    return best


def _tree(rows: list, depth: int):
    """Nested (feature, cut, low, high) tuples with leaf values."""
    found = _split(rows) if depth else None
    if found is None:
        return _leaf(rows)
    _, f, cut, low, high = found
    return f, cut, _tree(low, depth - 1), _tree(high, depth - 1)


def _value(tree, x) -> float:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if x[f] < cut else high
    return tree


def boost(table: list) -> tuple[float, list]:
    """(start, trees): Newton boosting of the logistic loss on weighted vectors."""
    pos, neg = sum(r[1] for r in table), sum(r[2] for r in table)
    start = math.log((pos + 1) / (neg + 1))
    score, trees = {r[0]: start for r in table}, []
    for _ in range(TREES if pos and neg else 0):
        rows = []
        for x, p, n in table:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, score[x]))))
            rows.append((x, p - (p + n) * q, (p + n) * q * (1 - q)))
        tree = _tree(rows, 2)
        trees.append(tree)
        for x in score:
            score[x] += RATE * _value(tree, x)
    return start, trees


def thresholds(table: list, start: float, trees: list) -> dict[int, float]:
    """Per generator the lowest score at which the precision of everything above
    reaches PRECISION; generators that never reach it are left out."""
    out = {}
    for gen in range(len(BASE), len(BASE) + len(WIDE)):
        own = sorted(((start + RATE * sum(_value(t, x) for t in trees), p, n)
                      for x, p, n in table if x[0] == gen), reverse=True)
        pos = neg = 0.0
        for i, (s, p, n) in enumerate(own):
            pos, neg = pos + p, neg + n
            if (i + 1 == len(own) or own[i + 1][0] < s) and pos >= PRECISION * (pos + neg) and pos:
                out[gen] = s - 1e-9
    return out


def _sql(tree, x: str) -> str:
    if not isinstance(tree, tuple):
        return repr(float(tree)) + "D"
    f, cut, low, high = tree
    return f"case when {x}.{list(FEATURES)[f]} < {cut} then {_sql(low, x)} else {_sql(high, x)} end"


def select_spans(found: DataFrame, start: float, trees: list, limits: dict[int, float]) -> DataFrame:
    """``found`` plus ``more``: the chosen candidates (s, e, gen, score)."""
    score = " + ".join([repr(float(start)) + "D"] + [f"{RATE}D * ({_sql(t, 'x')})" for t in trees])
    passes = " or ".join(f"(x.gen = {g} and x.score >= {s!r}D)" for g, s in limits.items()) or "false"
    scored = found.withColumn("more", F.expr(f"""filter(transform(
        filter(wide, x -> not exists(base, b -> b.s < x.e and x.s < b.e)),
        x -> named_struct('s', x.s, 'e', x.e, 'gen', x.gen, 'score', {score})), x -> {passes})"""))
    # From the best score down, whatever overlaps no span chosen before.
    return scored.withColumn("more", F.expr("""aggregate(
        array_sort(more, (a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1
            when a.s <> b.s then a.s - b.s else a.gen - b.gen end),
        cast(array() as array<struct<s:int,e:int,gen:int,score:double>>),
        (kept, x) -> case when exists(kept, y -> y.s < x.e and x.s < y.e) then kept
            else concat(kept, array(x)) end)"""))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_model, base_sha256, spans) per row."""
    found = stored(spans(docs, id_col, text_col), "pii-spans")
    table = feature_table(found)
    start, trees = boost(table)
    out = select_spans(found, start, trees, thresholds(table, start, trees))
    names = "array(" + ",".join(f"'{k}'" for k in (*BASE, *WIDE)) + ")"
    # Base spans are already in order: kinds as listed, then start.
    tag = f"x -> concat({names}[x.gen], ':', x.s, ':', x.e)"
    counts = [F.expr(f"cast(size(filter(base, x -> x.gen = {i})) as bigint)").alias(f"n_{k}")
              for i, k in enumerate(BASE)]
    return out.select(
        id_col, *counts, F.size("more").cast("long").alias("n_model"),
        F.sha2(F.expr(f"array_join(transform(base, {tag}), ',')"), 256).alias("base_sha256"),
        F.expr(f"""array_join(concat(transform(base, {tag}),
            transform(array_sort(more, (a, b) -> case when a.gen <> b.gen then a.gen - b.gen else a.s - b.s end),
            {tag})), ',')""").alias("spans"))


def redacted(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by a mark (ids must be unique)."""
    cuts = found.select(F.col(id_col).alias("_id"), F.expr("""
        array_sort(transform(filter(split(spans, ','), x -> x <> ''),
          x -> named_struct('s', cast(split(x, ':')[1] as int), 'e', cast(split(x, ':')[2] as int))))""").alias("_c")) \
        .where(F.size("_c") > 0)
    out = docs.join(cuts, docs[id_col] == cuts["_id"], "left")
    text = F.expr(f"""case when _c is null then `{text_col}` else
      aggregate(_c, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', greatest(a.at, x.e),
        'out', concat(a.out, case when x.s >= a.at
            then concat(substring(`{text_col}`, a.at + 1, x.s - a.at), '[PII]') else '' end)),
        a -> concat(a.out, substring(`{text_col}`, a.at + 1))) end""")
    return out.withColumn(text_col, text).select(*docs.columns)
