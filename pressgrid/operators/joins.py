"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when it has at most this many rows (base URLs or
# hashes of ~100 bytes: about 25 MB); above it the join stays a shuffle join
# (sort-merge; AQE may still switch at run time from measured sizes).
DEFAULT_BROADCAST_ROWS = 250_000


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Return ``broadcast(df)`` when ``df`` provably has at most ``max_rows`` rows.

    The check counts at most ``max_rows + 1`` rows, so it stays cheap when the
    side is large; in that case ``df`` is returned as is and the planner keeps
    a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def salted_lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left",
                       hot_rows: int = 1_000_000, buckets: int = 32,
                       salt_from: str | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Join ``left`` to a lookup ``right`` (at most one row per ``key``) with hot
    keys spread over ``buckets`` tasks.

    A key is hot when ``left`` holds more than ``hot_rows`` rows of it; the hot
    set comes from a pre-aggregated count, so it is small (at most
    rows / ``hot_rows`` keys) and is broadcast behind the size check.  Rows of
    a hot key get a salt from a hash of ``salt_from`` (deterministic, so a
    retried task salts the same way); the lookup row of a hot key is copied
    once per salt.  Cold keys join as before with salt 0, so the result equals
    the plain join while no task receives more than about
    ``rows_of_hot_key / buckets`` rows of one key.  ``hot`` may hold the hot
    keys already (one column ``key``), e.g. from a count the caller makes
    anyway; it is then joined as is and AQE broadcasts it from its measured
    size.
    """
    if hot is None:
        hot = broadcast_if_small(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
                                 .where(F.col("_n") > hot_rows).select(key))
    hot = hot.select(key, F.lit(True).alias("_hot"))
    src = F.col(salt_from) if salt_from else F.col(key)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(src), F.lit(buckets))).otherwise(F.lit(0)).cast("int")
    l = left.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))
    r = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return l.join(r, [key, "_salt"], how).drop("_salt")
