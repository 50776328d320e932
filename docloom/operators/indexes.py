"""Secondary layouts: sorted copies for ordered lookups, hashed copies for equality.

A sorted copy is range-partitioned and sorted, so Parquet min/max statistics skip row
groups.  A hashed one is written in folders by bucket, as many as its rows ask for, and
a lookup computes the key's bucket, so all other folders are pruned; a bucket that one
key fills is split over tasks and files.  Lookups are plain predicates, which also hold
on the bundle itself.  Only documents that lack the leading key are left out of a
layout: no lookup, which always tests that key, could find them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources.scratch import settled

#: Documents of a bucket, and the fewest and most buckets of a layout.
ROWS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 250_000, 8, 100_000
BUCKET = "_bucket"


def sorted_copy(df: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """Keys and ids in key order, documents that lack the leading key left out."""
    known = df.select(*keys, *[c for c in id_cols if c not in keys]).dropna(subset=keys[:1])
    order = [*keys, *[c for c in id_cols if c not in keys]]
    return known.repartitionByRange(*order).sortWithinPartitions(*order)


def bucket_of(key: Column, kind: T.DataType, buckets: int, ignore_case: bool = False) -> Column:
    """A key's bucket; on a literal it is a constant, which prunes the other buckets' folders."""
    return F.pmod(F.xxhash64(hash_key(key.cast(kind), ignore_case)), F.lit(buckets)).cast("int")


def bucket_count(rows: int) -> int:
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-rows // ROWS_PER_BUCKET)))


def hashed_copy(df: DataFrame, key: str, id_cols: list[str], buckets: int, ignore_case: bool = False) -> DataFrame:
    """Key, ids and bucket, to be written by bucket: adaptive execution splits a bucket that is too large for a task."""
    known = df.select(key, *[c for c in id_cols if c != key]).where(F.col(f"`{key}`").isNotNull())
    placed = known.withColumn(BUCKET, bucket_of(F.col(f"`{key}`"), df.schema[key].dataType, buckets, ignore_case))
    return placed.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, key)


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def between(df: DataFrame, key: str, start=None, end=None) -> DataFrame:
    """Closed interval; None leaves a side open."""
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    return df.where(F.col(key) <= F.lit(end)) if end is not None else df


def composite(df: DataFrame, keys: list[str], values: list) -> DataFrame:
    """Equality on all keys, or on a prefix when fewer values are given."""
    return df.where(equal(keys, values))


def _beyond(keys: list[str], bound: list, strict_op: str) -> Column:
    """Lexicographic comparison of the keys with a bound, the bound included."""
    head, *rest = list(zip(keys, bound))
    key, value = F.col(head[0]), F.lit(head[1])
    past = key > value if strict_op == ">" else key < value
    if not rest:
        return past | (key == value)
    return past | ((key == value) & _beyond([k for k, _ in rest], [v for _, v in rest], strict_op))


def composite_between(df: DataFrame, keys: list[str], start: list | None, end: list | None) -> DataFrame:
    """Lexicographic closed interval.  The leading key is also bounded by itself, which reaches the scan."""
    return df.where(within(keys, start, end))


def within(keys: list[str], start: list | None, end: list | None) -> Column:
    """The closed interval as a condition."""
    found = F.lit(True)
    if start:
        found = found & (F.col(keys[0]) >= F.lit(start[0])) & _beyond(keys, start, ">")
    if end:
        found = found & (F.col(keys[0]) <= F.lit(end[0])) & _beyond(keys, end, "<")
    return found


def equal(keys: list[str], values: list) -> Column:
    """Equality on all keys, or on a prefix when fewer values are given, as a condition."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(keys, values)])


def unique_keys(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """One document per key: the smallest id stays."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.min(id_col).alias("doc_id"))


def numbered(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(key.., doc_id, tid): positions from 1 in (key, id) order, without a single-task window.

    The sorted rows are written once; each partition's count gives the others' offset.
    """
    rows = sorted_copy(df.dropna(subset=keys), keys, [id_col]).select(*keys, F.col(id_col).alias("doc_id"))
    placed = settled(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    tid = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(offsets), "part").select(*keys, "doc_id", tid.alias("tid"))


def hash_key(col: Column, case_insensitive: bool = False) -> Column:
    return F.lower(col) if case_insensitive else col


def hash_lookup(df: DataFrame, key: str, value, case_insensitive: bool = False) -> DataFrame:
    return df.where(hash_key(F.col(key), case_insensitive) == hash_key(F.lit(value), case_insensitive))


def hash_duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) for the keys that a unique hashed layout must refuse."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def key_value_lookup(df: DataFrame, pairs: dict) -> DataFrame:
    return df.where(equal(list(pairs), list(pairs.values())))
