"""Verification: tail comparison by row hash and full comparison by bucket checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.columns import quoted, resolve_key, select_as, verify_columns
from tablesync.functions.hashing import (
    MAX_COMBINED_ROWS,
    combined,
    md5_words,
    row_hash,
    tagged_row_text,
    text_columns,
    value_words,
)
from tablesync.functions.text import key_text, md5_hex, text_of
from tablesync.model import Key

MATCH, DIFFERENT = "match", "different"
MISSING_IN_SRC, MISSING_IN_DST = "missing_in_src", "missing_in_dst"

# Fixed value: how many mismatched keys a report names.
SAMPLE_KEYS = 50

BUCKET = "bucket"
# Names that do not meet those of table columns.
_BUCKET, _SIDE, _IN_SRC = "__bucket", "__side", "__in_src"
# Most differing buckets whose numbers are sent to every executor (4 bytes each).
MAX_BUCKETS = 1 << 20


def tail_by_key(df: DataFrame, key: Key, n: int = 10) -> DataFrame:
    """The last ``n`` rows by key, descending.

    Two steps: the n-th largest key comes from a scan of the key column alone; the scan of the wide rows then carries
    ``key >= that value`` as a filter, so row groups below it are skipped. The top-n never sorts the table.
    """
    keys = resolve_key(df, key)
    order = [F.col(quoted(k)).desc() for k in keys]
    if len(df.columns) == len(keys):
        return df.orderBy(*order).limit(n)
    lead = F.col(quoted(keys[0]))
    floor = df.select(lead).orderBy(lead.desc()).limit(n).agg(F.min(lead)).scalar()
    return df.where((lead >= floor) | lead.isNull()).orderBy(*order).limit(n)


def comparable_sides(src: DataFrame, dst: DataFrame, key: Key) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides reduced to the columns to verify, in destination spelling."""
    cols = verify_columns(src, dst, key)
    if not cols:
        raise ValueError("no columns to verify: all destination columns are generated")
    src, dst = select_as(src, cols), select_as(dst, cols)
    common = {c: t for c in cols if (t := common_number(src.schema[c].dataType, dst.schema[c].dataType))}
    cast = {c: F.col(quoted(c)).cast(t) for c, t in common.items()}
    return (src.withColumns(cast), dst.withColumns(cast), cols) if cast else (src, dst, cols)


def common_number(a: T.DataType, b: T.DataType) -> T.DecimalType | None:
    """Decimal type that holds all values of two different integral or decimal types; None if there is none."""
    digits = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}

    def parts(t: T.DataType) -> tuple[int, int] | None:
        if isinstance(t, T.DecimalType):
            return t.precision - t.scale, t.scale
        return (digits[t.simpleString()], 0) if t.simpleString() in digits else None

    left, right = parts(a), parts(b)
    if a == b or not left or not right:
        return None
    whole, scale = max(left[0], right[0]), max(left[1], right[1])
    return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None


def compare_rows(dst_hashes: DataFrame, src_hashes: DataFrame, key: Key) -> DataFrame:
    """``(key, dst_hash, src_hash, status)`` for every destination row; the source side may be missing.

    The source is reduced to one hash per key before the join (the smallest where a key is not unique), so a repeated
    key cannot multiply rows.
    """
    keys = resolve_key(dst_hashes, key)
    right = src_hashes.groupBy(*[quoted(k) for k in keys]).agg(F.min("row_hash").alias("src_hash"))
    left = dst_hashes.withColumnRenamed("row_hash", "dst_hash")
    status = (
        F.when(F.col("src_hash").isNull(), MISSING_IN_SRC)
        .when(F.col("src_hash") == F.col("dst_hash"), MATCH)
        .otherwise(DIFFERENT)
    )
    return left.join(right, keys, "left_outer").withColumn("status", status)


def verify_tail_rows(
    src: DataFrame, dst: DataFrame, key: Key, n: int = 10, float_scale: int | None = None
) -> DataFrame:
    """The last ``n`` destination rows compared with the source rows of the same keys.

    At most ``n`` keys (bounded, see ``MAX_COMBINED_ROWS``) go to the executors that scan the source; the smallest of
    them is also a scan filter.
    """
    if not 0 < n <= MAX_COMBINED_ROWS:
        raise ValueError(f"a tail has 1 to {MAX_COMBINED_ROWS} rows; use verify_full for whole tables")
    src, dst, cols = comparable_sides(src, dst, key)
    keys = resolve_key(dst, key)
    tail = tail_by_key(dst, keys, n)
    tail_keys = tail.select(*[quoted(k) for k in keys])
    lead = F.col(quoted(keys[0]))
    floor = tail_keys.agg(F.min(lead)).scalar()
    same = src.where(lead >= floor).join(F.broadcast(tail_keys), keys, "left_semi")
    return compare_rows(
        row_hash(tail, keys, cols, float_scale),
        row_hash(same.select(*[quoted(c) for c in cols]), keys, cols, float_scale),
        keys,
    )


def tail_summary(rows: DataFrame, key: Key) -> DataFrame:
    """One row ``(dst_hash, src_hash, match, mismatches, compared)`` of :func:`verify_tail_rows`.

    ``match`` is decided by the combined hashes. A row missing in the source counts as mismatch, not as compared.
    """
    order = key_text(rows, resolve_key(rows, key))
    return rows.agg(
        combined(order, F.col("dst_hash")).alias("dst_hash"),
        combined(order, F.col("src_hash")).alias("src_hash"),
        F.count_if(F.col("status") != MATCH).alias("mismatches"),
        F.count_if(F.col("status") != MISSING_IN_SRC).alias("compared"),
    ).select("dst_hash", "src_hash", (F.col("dst_hash") == F.col("src_hash")).alias("match"), "mismatches", "compared")


def mismatch_sample(rows: DataFrame, key: Key, n: int = SAMPLE_KEYS) -> DataFrame:
    """The first ``n`` mismatched keys by key descending, each with the total number of mismatches."""
    keys = resolve_key(rows, key)
    bad = rows.where(F.col("status") != MATCH).select(*[quoted(k) for k in keys], "status")
    total = bad.agg(F.count(F.lit(1))).scalar()
    return bad.orderBy(*[F.col(quoted(k)).desc() for k in keys]).limit(n).withColumn("mismatches", total)


def verify_tail(
    src: DataFrame, dst: DataFrame, key: Key, n: int = 10, float_scale: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Summary and mismatch sample of the tail comparison."""
    rows = verify_tail_rows(src, dst, key, n, float_scale)
    return tail_summary(rows, key), mismatch_sample(rows, key)


def key_bucket(df: DataFrame, key: Key, buckets: int, as_text: set[str] = frozenset()) -> Column:
    """Bucket number of the key; by text where the key types of the sides differ, so that both agree."""
    parts = []
    for k in resolve_key(df, key):
        c = F.col(quoted(k))
        parts.append(text_of(c, df.schema[k].dataType) if k in as_text else c)
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def bucket_words(df: DataFrame, cols: list[str], as_text: set[str], checksum: str, scale: int | None) -> list[Column]:
    if checksum == "md5":
        return md5_words(md5_hex(tagged_row_text(df, cols, scale)))
    if checksum != "xxhash64":
        raise ValueError(f"unknown checksum {checksum!r}")
    return value_words(df, cols, as_text, scale)


def _named_words(words: list[Column]) -> list[Column]:
    return [c.alias(f"__w{i}") for i, c in enumerate(words)]


def verify_buckets(
    src: DataFrame,
    dst: DataFrame,
    key: Key,
    buckets: int = 4096,
    float_scale: int | None = None,
    bucket_of: Column | None = None,
    checksum: str = "xxhash64",
) -> DataFrame:
    """Row count and checksum of both sides per key bucket.

    One scan per side and one small shuffle: every task reduces its rows to at most ``buckets`` partial sums, whatever
    the number of rows or the weight of one key. ``bucket_of`` replaces the hash bucket by an own expression.
    ``checksum="md5"`` adds up words of the MD5 row hashes, which other engines can reproduce.
    """
    src, dst, cols = comparable_sides(src, dst, key)
    as_text = text_columns(src, dst, cols)
    parts = []
    for df, in_src in ((src, True), (dst, False)):
        bucket = bucket_of if bucket_of is not None else key_bucket(df, key, buckets, as_text)
        words = bucket_words(df, cols, as_text, checksum, float_scale)
        parts.append(df.select(bucket.alias(BUCKET), F.lit(in_src).alias(_IN_SRC), *_named_words(words)))
    sides = (("src", F.col(_IN_SRC)), ("dst", ~F.col(_IN_SRC)))
    grouped = parts[0].unionByName(parts[1]).groupBy(BUCKET).agg(
        *[F.count_if(side).alias(f"{name}_rows") for name, side in sides],
        *[
            F.coalesce(F.sum(F.when(side, F.col(f"__w{w}"))), F.lit(0)).alias(f"{name}_sum{w}")
            for name, side in sides
            for w in range(len(words))
        ],
    )
    equal = F.col("src_rows") == F.col("dst_rows")
    for w in range(len(words)):
        equal = equal & (F.col(f"src_sum{w}") == F.col(f"dst_sum{w}"))
    return grouped.withColumn("equal", equal)


def differing_buckets(buckets: DataFrame) -> DataFrame:
    return buckets.where(~F.col("equal")).select(BUCKET)


def verify_full(
    src: DataFrame,
    dst: DataFrame,
    key: Key,
    buckets: int = 4096,
    float_scale: int | None = None,
    checksum: str = "xxhash64",
) -> DataFrame:
    """Every key that differs: ``(key, status)`` with missing_in_src, missing_in_dst or different.

    Buckets with equal checksums are closed after the first pass; only rows of differing buckets are shuffled by key.
    Their numbers are a broadcast bounded by ``buckets``. Both sides are compared in one aggregation with fixed-width
    counters instead of a full outer join: it combines on the map side and has no skew problem with repeated keys. Rows
    that share a key are compared as a multiset.
    """
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MAX_BUCKETS}")
    found = verify_buckets(src, dst, key, buckets, float_scale, checksum=checksum)
    diff = F.broadcast(differing_buckets(found).withColumnRenamed(BUCKET, _BUCKET))
    key_type = {k: dst.schema[k].dataType for k in resolve_key(dst, key)}
    src, dst, cols = comparable_sides(src, dst, key)
    as_text, keys = text_columns(src, dst, cols), resolve_key(dst, key)
    suspects = [
        df.withColumn(_BUCKET, key_bucket(df, keys, buckets, as_text)).join(diff, _BUCKET, "left_semi").drop(_BUCKET)
        for df in (src, dst)
    ]
    return compare_keys(*suspects, keys, cols, as_text, key_type, float_scale, checksum)


def compare_keys(
    src: DataFrame,
    dst: DataFrame,
    key: Key,
    cols: list[str],
    as_text: set[str],
    key_types: dict[str, T.DataType],
    float_scale: int | None = None,
    checksum: str = "xxhash64",
) -> DataFrame:
    """``(key, status)`` of the keys whose rows differ as multisets, over comparable sides (all rows of a key or none)."""
    keys, parts = resolve_key(dst, key), []
    for df, sign in ((src, 1), (dst, -1)):
        words = [c * sign for c in bucket_words(df, cols, as_text, checksum, float_scale)]
        parts.append(df.select(
            *[F.col(quoted(k)).cast(key_types[k]).alias(k) for k in keys],
            F.lit(sign).alias(_SIDE),
            *_named_words(words),
        ))
    per_key = parts[0].unionByName(parts[1]).groupBy(*[quoted(k) for k in keys]).agg(
        F.count_if(F.col(_SIDE) == 1).alias("__src"),
        F.count_if(F.col(_SIDE) == -1).alias("__dst"),
        *[F.sum(f"__w{w}").alias(f"__w{w}") for w in range(len(words))],
    )
    equal = F.col("__src") == F.col("__dst")
    for w in range(len(words)):
        equal = equal & (F.col(f"__w{w}") == 0)
    status = (
        F.when(F.col("__src") == 0, MISSING_IN_SRC).when(F.col("__dst") == 0, MISSING_IN_DST).otherwise(DIFFERENT)
    )
    return per_key.where(~equal).select(*[quoted(k) for k in keys], status.alias("status"))


def reconcile_counts(exported: DataFrame, imported: DataFrame) -> DataFrame:
    """One row ``(exported, imported, ok)``; not ok where rows were exported and a different number arrived."""
    arrived = imported.agg(F.count(F.lit(1))).scalar()
    counts = exported.agg(F.count(F.lit(1)).alias("exported")).withColumn("imported", arrived)
    bad = (F.col("exported") > 0) & (F.col("imported") != F.col("exported"))
    return counts.withColumn("ok", ~bad)
