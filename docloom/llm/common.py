"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame):
    """The text column; null counts as empty."""
    return F.coalesce(docs["text"], F.lit(""))


#: A table of at most so many rows of a few numbers, about 100 bytes each, may be broadcast to be joined.
BROADCAST_ROWS = 50_000
#: Keys with more rows than this, and than a 1 / MOST_HOT share of all rows, are joined apart from the others.
HOT_ROWS, MOST_HOT = 10_000, 50_000


def shared_folder(spark: SparkSession) -> str:
    """The session's folder below ``spark.checkpoint.dir``, which all executors see.

    Only in local mode, where driver and executors are one process, one is chosen
    where none is set.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docloom-"))
    return sc.getCheckpointDir()


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder.  What is left of it goes when the application ends."""
    home = f"{shared_folder(spark)}/work-{spark.sparkContext.applicationId}"
    files, at = _hadoop(spark, home)
    if not files.exists(at):
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any Hadoop file system."""
    files, at = _hadoop(spark, path)
    files.delete(at, True)


def written(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder, read again, and its path: lineage is cut and later reads are pruned."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """``written`` without the path, for what lives until the application ends."""
    return written(df, name)[0]


def by_rows(df: DataFrame, rows: int) -> DataFrame:
    """df as the right side of a join: broadcast up to BROADCAST_ROWS rows, shuffled beyond.

    Spark would guess from bytes of Parquet, which miss compression and exploded arrays:
    what it took for less than its default of 10 MB did not fit a driver heap of 750 MB.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined with groups (one row a key; size: how many rows have it) on key.

    A key of more than HOT_ROWS rows and of more than a 1 / MOST_HOT share of ``total``
    is joined by broadcast: there are at most MOST_HOT such keys.  Rows of these keys,
    and rows whose key is null, go through the shuffle of the others under keys of
    their own, so no task gets more than one cold key's rows beside its share.
    """
    names = [c for c in groups.columns if c != key]
    least = max(HOT_ROWS, total // MOST_HOT)
    hot = groups.where(F.col(size) > least).select(F.col(key).alias("_hot"), F.struct(*names).alias("_of_hot"))
    cold = groups.where(F.col(size) <= least).select(F.col(key).alias("_cold"), F.struct(*names).alias("_of_cold"))
    met = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left")
    apart = F.col("_hot").isNotNull() | rows[key].isNull()
    alone = F.when(apart, F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    met = met.withColumn("_alone", alone).withColumn("_key", F.when(~apart, rows[key]))
    # 0 stands for rows that look for their cold key; the row numbered 0 has no key and meets none.
    cold = cold.withColumn("_zero", F.lit(0).cast("long"))
    joined = met.join(cold.hint("merge"), (met["_key"] == cold["_cold"]) & (met["_alone"] == cold["_zero"]), "left")
    found = joined.withColumn("_of", F.coalesce("_of_hot", "_of_cold"))
    return found.select(*[F.col(c) for c in rows.columns], *[F.col("_of")[c].alias(c) for c in names])


def fold_is_held_out(doc_id):
    """True for the rows whose crc32 of the decimal id leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def give_back() -> None:
    """Return what this process has freed to the system: a worker lives on through the next stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def per_process(key, make: Callable):
    """make() once per Python worker process; later tasks in the worker share it.

    A worker keeps one such object: another operator's goes when this one's comes, in
    cycles as it may be (a memo that calls its owner).
    """
    import gc
    import sys
    import types

    state = sys.modules.setdefault("_docloom_worker_state", types.ModuleType("_docloom_worker_state"))
    if getattr(state, "key", None) != key:
        state.key = state.value = None
        gc.collect()
        give_back()
        state.value = make()
        state.key = key
    return state.value


class Remembered(dict):
    """A bounded memo of make(key): at ``most`` entries a generation is set aside,
    and what is asked again comes back from it.  Long keys are never kept."""

    def __init__(self, make: Callable, most: int, longest: int = 64):
        self.make, self.most, self.longest, self.aside = make, most, longest, {}

    def __missing__(self, key):
        value = self.aside.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.aside = dict(self)
                self.clear()
            self[key] = value
        return value


def map_texts(docs: DataFrame, columns: list[str], schema: str, start: Callable, rows: int = 256) -> DataFrame:
    """Map (columns..., text) to rows of schema in Arrow batches, without a shuffle.

    start() runs in each task and returns fn(key_lists, texts) -> list of column
    lists.  Only a slice of the batch is held as Python objects at a time.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import gc

        import pyarrow as pa

        fn = start()
        gc.disable()  # texts make many lists and no cycles
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    lists = [part.column(i).to_pylist() for i in range(part.num_columns)]
                    made = fn(lists[:-1], lists[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, out_schema)], schema=out_schema)
        finally:
            gc.enable()
            give_back()

    picked = [docs[c].cast("long").alias(c) if c == "doc_id" else docs[c] for c in columns]
    return docs.select(*picked, text_of(docs).alias("text")).mapInArrow(run, schema)
