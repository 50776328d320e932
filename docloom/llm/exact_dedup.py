"""Exact dedup of incoming rows against an immutable snapshot.

Both sides are reduced to one group per SHA-256 digest with map-side combining,
so a text that a third of all rows share is one row from there on.  The
snapshot's digests are dealt to shards of bounded size and each shard keeps a
static 3-wise binary fuse filter.  ``save_snapshot`` writes buckets and filters once;
``Snapshot`` reads them for every batch that comes (``against``).  Incoming group digests are screened by their
shard's filter: negatives are new for certain, positives join the snapshot's exact
buckets, and the texts behind both sides are compared byte for byte.  Duplicates
within the incoming batch are grouped on their own, without the filter.

Null texts count as empty; empty texts are equal to each other.  Of equal texts
the row with the largest doc_id stays; repeated rows with one doc_id share its
verdict, and a group without any doc_id keeps all its rows (``one_of_each`` leaves one
row of either).  An empty table gives no rows.  Additional columns do not matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common

KEYS_PER_SHARD = 100_000
FILTER_SCHEMA = "shard int, shards int, seed long, segment_length int, segment_count int, prints binary"
#: So many ids, about 80 bytes each with their digest, are broadcast to pick the texts to check; beyond, texts are joined by shuffle.
BROADCAST_IDS = 300_000


def mixed(keys, seed: int):
    """64-bit finalizer over uint64 keys."""
    import numpy as np

    x = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class BinaryFuse:
    """A static 3-wise binary fuse filter of 16-bit prints over distinct uint64 keys."""

    def __init__(self, seed: int, segment_length: int, segment_count: int, prints):
        self.seed, self.length, self.count, self.prints = seed, segment_length, segment_count, prints

    @staticmethod
    def slots(h, length: int, count: int):
        import numpy as np

        u = np.uint64
        first = ((h >> u(32)) * u(count * length)) >> u(32)
        mask = u(length - 1)
        return np.stack([first, (first + u(length)) ^ ((h >> u(18)) & mask), (first + u(2 * length)) ^ (h & mask)]).astype(np.int64)

    @staticmethod
    def print_of(h):
        import numpy as np

        return (h ^ (h >> np.uint64(32)) ^ (h >> np.uint64(16))).astype(np.uint16)

    @classmethod
    def build(cls, keys) -> BinaryFuse:
        import numpy as np

        n = len(keys)
        length = 1 << min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        count = max(1, math.ceil(max(32, n * factor) / length) - 2)
        for seed in range(1, 1000):
            h = mixed(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
            at = cls.slots(h, length, count)
            order = cls._peel(at, (count + 2) * length)
            if order is None:
                continue
            prints, own = np.zeros((count + 2) * length, np.uint16), cls.print_of(h)
            for some, slot in reversed(order):
                others = prints[at[0, some]] ^ prints[at[1, some]] ^ prints[at[2, some]]
                prints[slot] = others ^ own[some]  # its own slot is still 0
            return cls(seed, length, count, prints)
        raise ValueError("no seed peels; are the keys distinct?")

    @staticmethod
    def _peel(at, size: int):
        """Rounds of (keys, the slot each key has alone), or None if a core remains."""
        import numpy as np

        n = at.shape[1]
        held, ids = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for row in at:
            np.add.at(held, row, 1)
            np.bitwise_xor.at(ids, row, np.arange(n))
        order, done, look = [], 0, np.arange(size)
        while done < n:
            alone = look[held[look] == 1]
            if not len(alone):
                return None
            some, first = np.unique(ids[alone], return_index=True)
            order.append((some, alone[first]))
            done += len(some)
            look = np.unique(at[:, some])
            for row in at:
                np.subtract.at(held, row[some], 1)
                np.bitwise_xor.at(ids, row[some], some)
        return order

    def may_hold(self, keys):
        h = mixed(keys, self.seed * 0x9E3779B97F4A7C15 % 2**64)
        a, b, c = self.slots(h, self.length, self.count)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == self.print_of(h)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of whole texts."""
    return docs.select("doc_id", F.sha2(common.text_of(docs), 256).alias("text_sha256"))


def groups(rows: DataFrame) -> DataFrame:
    """(text_sha256, top_id, n): the exact buckets of one side."""
    return rows.groupBy("text_sha256").agg(F.max("doc_id").alias("top_id"), F.count("*").alias("n"))


def _by_shard(df: DataFrame, shards: int) -> DataFrame:
    key = F.xxhash64("text_sha256")
    return df.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), key.alias("key"), "text_sha256")


def _runs(batches):
    """(shard, batches of that shard's rows) from batches sorted by shard."""
    import pyarrow as pa

    shard, held = None, []
    for batch in batches:
        at = batch.column(0).to_numpy(zero_copy_only=False)
        start = 0
        while start < len(at):
            stop = start + int((at[start:] == at[start]).sum())
            if shard is not None and at[start] != shard:
                yield shard, pa.Table.from_batches(held)
                held = []
            shard, held = at[start], [*held, batch.slice(start, stop - start)]
            start = stop
    if held:
        yield shard, pa.Table.from_batches(held)


def build_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """One binary fuse filter per shard of the snapshot's groups."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for shard, rows in _runs(batches):
            keys = np.unique(rows.column("key").to_numpy().view(np.uint64))
            made = BinaryFuse.build(keys)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "shards": pa.array([shards], pa.int32()), "seed": [made.seed], "segment_length": pa.array([made.length], pa.int32()), "segment_count": pa.array([made.count], pa.int32()), "prints": [made.prints.tobytes()]})

    keys = _by_shard(snapshot, shards).select("shard", "key")
    return keys.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, FILTER_SCHEMA)


@dataclass(frozen=True)
class Snapshot:
    """An immutable snapshot's exact buckets (text_sha256, top_id, n) and filters, as files below path."""

    buckets: DataFrame
    filters: DataFrame
    shards: int

    @staticmethod
    def load(spark: SparkSession, path: str) -> Snapshot:
        filters = spark.read.parquet(f"{path}/filters")
        first = filters.select("shards").first()
        return Snapshot(spark.read.parquet(f"{path}/buckets"), filters, first["shards"] if first else 1)


def save_snapshot(rows: DataFrame, path: str) -> Snapshot:
    """Write the buckets and filters of rows (doc_id, text_sha256); a folder that is there is not overwritten."""
    spark = rows.sparkSession
    groups(rows).write.parquet(f"{path}/buckets")
    buckets = spark.read.parquet(f"{path}/buckets")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(buckets.count() / KEYS_PER_SHARD))
    build_filters(buckets, shards).write.parquet(f"{path}/filters")
    return Snapshot.load(spark, path)


def screen(incoming: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The text_sha256 of the incoming groups that the snapshot may hold.

    A shard's filter comes before the digests that ask it, which then pass in batches.
    """
    shards = snapshot.shards
    nothing = lambda kind: F.lit(None).cast(kind)
    asked = _by_shard(incoming, shards).select("shard", "key", "text_sha256", nothing("long").alias("seed"), nothing("int").alias("segment_length"), nothing("int").alias("segment_count"), nothing("binary").alias("prints"))
    kept = snapshot.filters.select("shard", nothing("long").alias("key"), nothing("string").alias("text_sha256"), "seed", "segment_length", "segment_count", "prints")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shard, fuse = None, None
        for batch in batches:
            at, keys, seeds = batch.column(0).to_numpy(), batch.column(1), batch.column(3)
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b and at[a] != shard:
                    shard, fuse = at[a], None
                if a < b and seeds[a].is_valid:
                    f = batch.slice(a, 1).to_pylist()[0]
                    fuse = BinaryFuse(f["seed"], f["segment_length"], f["segment_count"], np.frombuffer(f["prints"], np.uint16))
                    a += 1
                if a < b and fuse is not None:
                    hit = fuse.may_hold(keys.slice(a, b - a).to_numpy().view(np.uint64))
                    yield batch.slice(a, b - a).filter(pa.array(hit)).select(["text_sha256"])

    dealt = asked.unionByName(kept).repartition(shards, "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first())
    return dealt.mapInArrow(run, "text_sha256 string")


def confirmed(docs: DataFrame, positives: DataFrame, snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """text_sha256 of the positives whose snapshot and incoming texts are the same bytes.

    Up to BROADCAST_IDS, only the texts to compare leave the tasks that read them.
    """
    both = positives.join(snapshot.select("text_sha256", F.col("top_id").alias("old_id")), "text_sha256").join(incoming.select("text_sha256", F.col("top_id").alias("new_id")), "text_sha256")
    asked = common.settled(both.select("text_sha256", F.explode(F.array("old_id", "new_id")).alias("doc_id")), "asked")
    texts = docs.select("doc_id", common.text_of(docs).alias("text"))
    named, few = asked.where("doc_id is not null"), asked.count() <= BROADCAST_IDS
    seen = texts.join(F.broadcast(named) if few else named, "doc_id").select("text_sha256", "text")
    nameless = asked.where("doc_id is null").select("text_sha256").distinct()
    if not nameless.isEmpty():  # a bucket without any doc_id is found by its digest
        seen = seen.unionByName(texts.where("doc_id is null").join(nameless, F.sha2("text", 256) == nameless["text_sha256"]).select("text_sha256", "text"))
    own = F.when(F.sha2("text", 256) == F.col("text_sha256"), F.col("text"))  # a repeated id may have other texts
    return seen.groupBy("text_sha256").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a = b").select("text_sha256")


def against(docs: DataFrame, rows: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for rows (doc_id, text_sha256, old), whose texts are in docs."""
    incoming = common.settled(groups(rows.where("not old")), "incoming")
    same = common.settled(confirmed(docs, screen(incoming, snapshot), snapshot.buckets, incoming), "same").withColumn("same", F.lit(True))
    # A side's group joins the other's only where the bytes agreed; a digest of one side is alone anyway.
    sides = snapshot.buckets.withColumn("old", F.lit(True)).unionByName(incoming.withColumn("old", F.lit(False))).join(same, "text_sha256", "left")
    apart = F.when(F.col("same"), F.lit(None).cast("boolean")).otherwise(F.col("old"))
    whole = sides.groupBy("text_sha256", apart.alias("apart")).agg(F.max("top_id").alias("keep_id"), F.sum("n").alias("group_size"))
    both = F.when(F.col("apart").isNull(), F.array(F.lit("1"), F.lit("0"))).otherwise(F.array(F.col("apart").cast("int").cast("string")))
    shared = whole.where("group_size > 1").select(F.explode(F.transform(both, lambda x: F.concat("text_sha256", x))).alias("bucket"), "keep_id", "group_size")
    rows = rows.withColumn("bucket", F.concat("text_sha256", F.col("old").cast("int").cast("string")))
    found = common.join_groups(rows, common.settled(shared, "shared"), "bucket", "group_size", rows.count())
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    found = found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    in_snapshot marks the rows of the immutable snapshot; the others are the batch.
    """
    rows = docs.select("doc_id", F.sha2(common.text_of(docs), 256).alias("text_sha256"), F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    rows = common.settled(rows, "digests")
    snapshot = save_snapshot(rows.where("old"), common.fresh(docs.sparkSession, "snapshot"))
    return against(docs, rows, snapshot)


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that ``found`` (a dedup of docs) keeps, and of repeated rows and of rows without any doc_id one per text."""
    clear = "_" * (1 + max(map(len, docs.columns)))  # no column has such a name
    dropped = common.settled(found.where("not kept").select("doc_id", "text_sha256").distinct(), "dropped")
    repeated = found.where("kept").groupBy("text_sha256").agg(F.count("*").alias("n")).where("n > 1").select("text_sha256")
    repeated = common.settled(repeated, "repeated")
    named = docs.withColumn(clear, F.sha2(common.text_of(docs), 256))
    kept = named.join(dropped, named["doc_id"].eqNullSafe(dropped["doc_id"]) & (named[clear] == dropped["text_sha256"]), "left_anti")
    if repeated.isEmpty():
        return kept.drop(clear)
    same = kept[clear] == repeated["text_sha256"]
    ordered = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    one = kept.join(repeated, same, "left_semi").groupBy(clear, common.text_of(docs)).agg(F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("_row"))
    return kept.join(repeated, same, "left_anti").drop(clear).unionByName(one.select("_row.*"))


def half(doc_id: Column) -> Column:
    """The standing split of one table into snapshot and batch."""
    return F.pmod(F.xxhash64(doc_id), F.lit(2)) == 0


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return dedup(docs, half(docs["doc_id"]))


ORACLE = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       coalesce(doc_id = max(doc_id) over w, max(doc_id) over w is null) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
