"""Benchmark decontamination with a broadcast hash set of word n-grams.

A-Z is lower-cased and words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
of documents and benchmark items.  A window is ``n`` consecutive words of an
item; an item with fewer words, but not none, is one window of its own length.
The distinct windows, keyed by a 64-bit hash, are a lookup that is broadcast in parts
of bounded size, one scan each.  Every window of every document is hashed and probed
without a shuffle;
each hash hit is verified word by word, and only verified hits are grouped.

Cases: null and empty texts have no words and are never contaminated; items
without words have no window; repeated items keep their own ids; an item id of
null is no item; an empty benchmark contaminates nothing; an empty table gives
an empty result; repeated or null document ids give a row each, of its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored

N_WORDS = 10
# A window is broadcast as hash, length and about 100 bytes of words: 250,000
# of them are about 40 MB.
BROADCAST_WINDOWS = 250_000
# What separates words, and the letters that are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str) -> Column:
    """The words of a text in order (null text: none).

    ``lower`` has a fast path for ASCII texts, where it equals the A-Z rule."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def _with_windows(df: DataFrame, w: str, lengths: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """``df`` with, per length, an array column of the hash of every window by
    start.  Hashes of 2, 4, 8, ... words are built by pairing neighbours and then
    joined to the wanted length, so a window costs a few steps, not ``length``."""
    df = df.withColumn("_h1", F.transform(w, lambda x: F.xxhash64(x)))

    def paired(left: str, right: str, by: int) -> Column:
        return F.expr(f"zip_with({left}, slice({right}, {by + 1}, size({right})), (a, b) -> xxhash64(a, b))")

    size = 1
    while size * 2 <= max(lengths):
        df = df.withColumn(f"_h{size * 2}", paired(f"_h{size}", f"_h{size}", size))
        size *= 2
    out = {}
    for ln in lengths:
        done, at = 0, None
        for k in reversed(range(ln.bit_length())):
            if ln >> k & 1:
                if at is None:
                    at = f"_h{1 << k}"
                else:
                    df = df.withColumn(f"_p{ln}_{k}", paired(at, f"_h{1 << k}", done))
                    at = f"_p{ln}_{k}"
                done += 1 << k
        out[ln] = f"_win{ln}"
        df = df.withColumn(out[ln], F.expr(f"slice({at}, 1, greatest(0, size({w}) - {ln - 1}))"))
    return df, out


def benchmark_windows(benchmark: DataFrame, n: int = N_WORDS, item_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """(h, len, win, item): one row per distinct window and item."""
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), words(text_col).alias("w")) \
        .where("item is not null and size(w) > 0")
    b = b.withColumn("len", F.least(F.size("w"), F.lit(n)))
    b, cols = _with_windows(b, "w", list(range(1, n + 1)))
    hashed = F.expr("case len " + " ".join(f"when {ln} then {c}" for ln, c in cols.items()) + " end")
    b = b.select("item", "len", "w", F.posexplode(hashed).alias("p", "h"))
    return b.select("h", "len", F.expr("array_join(slice(w, p + 1, len), ' ')").alias("win"), "item").distinct()


def window_hits(docs: DataFrame, windows: DataFrame, key: str, text_col: str = "text",
                n: int = N_WORDS) -> DataFrame:
    """(key, n_words, pos, len, win) for every verified window hit, pos from 1,
    plus one row per document with null pos that carries its word count.

    ``windows`` holds distinct (h, len, win).  They are broadcast in parts of about
    ``BROADCAST_WINDOWS``, each probed in a scan of its own: no text is shuffled, however
    many windows there are."""
    sizes = windows.agg(F.count(F.lit(1)).alias("n"), F.collect_set("len").alias("lens")).first()
    lens = sorted(set(sizes["lens"]) - {n}) + [n]  # at most n numbers
    passes = max(1, -(-sizes["n"] // BROADCAST_WINDOWS))
    rows = docs.select(F.col(key), words(text_col).alias("w")).withColumn("n_words", F.size("w"))
    rows, cols = _with_windows(rows, "w", lens)
    out = None
    for turn in range(passes):
        look = windows.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == turn) if passes > 1 else windows
        look = F.broadcast(look.select(F.col("h").alias("_h"), F.col("len").alias("_wl"), "win"))
        found = _probed(rows, cols, lens, look, key, n, turn == 0)
        out = found if out is None else out.unionByName(found)
    return out


def _probed(rows: DataFrame, cols: dict, lens: list[int], look: DataFrame, key: str, n: int, own_row: bool) -> DataFrame:
    """The hits of one broadcast part of the windows; with ``own_row`` also the row of
    each document itself."""
    # Element 0 of the exploded array stands for the document itself.
    parts = []
    for ln in lens:
        own_row_here = own_row and ln == n
        first = F.array(F.lit(None).cast("bigint")) if own_row_here else F.array().cast("array<bigint>")
        p = rows.select(key, "n_words", "w", F.posexplode(F.concat(first, F.col(cols[ln]))).alias("pos", "h"))
        if not own_row_here:
            p = p.withColumn("pos", F.col("pos") + 1)
        p = p.join(look, (F.col("h") == F.col("_h")) & (F.col("_wl") == ln), "left")
        same = F.array_join(F.slice("w", F.col("pos"), ln), " ") == F.col("win")
        own = F.col("h").isNull()
        p = p.where(own | (F.col("win").isNotNull() & (F.col("pos") > 0)))
        p = p.where(F.when(own, F.lit(own_row_here)).otherwise(same))
        parts.append(p.select(key, "n_words", F.when(~own, F.col("pos")).alias("pos"),
                              F.when(~own, F.lit(ln)).alias("len"), "win"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _covered(spans: str) -> Column:
    """Words inside the union of (pos, len) spans, sorted by pos."""
    return F.expr(f"""aggregate({spans}, named_struct('upto', 0, 'n', 0L), (a, s) -> named_struct(
        'upto', greatest(a.upto, s.pos + s.len - 1),
        'n', a.n + greatest(0, s.pos + s.len - 1 - greatest(a.upto, s.pos - 1)))).n""")


def hits_by_document(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``spans`` are the hit (pos, len) windows in order.  The spans of one
    document are bounded by its own words; the items by the benchmark."""
    win = stored(benchmark_windows(benchmark, n, text_col=text_col), "bench-windows")
    # A row is told by its id and text; rows equal in both have equal results and count
    # as one until the end.
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("x"), F.octet_length(text).alias("n"))
    hits = window_hits(docs.select(row.alias("_row"), F.col(text_col).alias("_t")),
                       win.select("h", "len", "win").distinct(), "_row", "_t", n)
    per = hits.groupBy("_row").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("pos").isNull()).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "len")))).alias("spans"),
        F.collect_set("win").alias("wins"))
    per = stored(per, "hits")
    items = per.where(F.size("wins") > 0).select("_row", F.explode("wins").alias("win")) \
        .join(win.select("win", "item").distinct(), "win").groupBy("_row") \
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    out = per.join(items.withColumnRenamed("_row", "_same"), F.col("_row").eqNullSafe(F.col("_same")), "left")
    out = out.withColumn("items", F.coalesce("items", none)).withColumn("n_hit", _covered("spans"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(F.col("_row.id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"), "spans")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS,
                        text_col: str = "text") -> DataFrame:
    """The documents without any benchmark window, columns unchanged.

    Decided per row inside the scan (no id needed, nothing shuffles while the
    window hashes are few enough to be a checked, broadcast array); a hash hit
    is verified against the window's words."""
    win = stored(benchmark_windows(benchmark, n, text_col=text_col).select("h", "len", "win").distinct(),
                 "bench-windows")
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    bad = window_hits(docs.select(key.alias("x"), F.col(text_col).alias("t")), win, "x", "t", n) \
        .where("pos is not null").select(F.col("x").alias("bad")).distinct()
    bad = stored(bad, "contaminated")
    small = bad.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    rows = packed(docs).withColumn("x", F.xxhash64(F.coalesce(F.col(f"in.{text_col}"), F.lit(""))))
    return rows.join(F.broadcast(bad) if small else bad, F.col("x") == F.col("bad"), "left_anti").select("in.*")
