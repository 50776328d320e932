"""Document fingerprints: bottom-k sketches of word-shingle hashes, in built-in functions only.

A sketch is the ``K`` smallest distinct 48-bit hashes of a text's 5-word shingles
(lower-cased words; a shorter text is one shingle).  Sketches of parts merge into the
sketch of the whole, and estimate resemblance, containment and the number of distinct
shingles.  A fingerprint is the sketch's bytes in base64.

Null texts count as empty.  Texts without words have an empty sketch; two of them
resemble each other fully, and nothing else.  Repeated rows have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import common

K = 128
WORDS = 5
HASH_BITS = 48
#: Buckets of neighbouring ids follow the rows, a few for each shuffle partition at least.  The
#: driver holds two integers a bucket; past MOST_BUCKETS (1.6 thousand million rows) buckets grow.
ROWS_PER_BUCKET, BUCKETS_PER_PARTITION, MOST_BUCKETS = 25_000, 4, 65_536


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the bottom-k sketch of a text column, array<long> in ascending order.

    Each step is a column that the next reads twice, so Catalyst keeps the steps apart
    and none is computed twice.
    """
    w, p2, p4, p5 = (f"_{x}_{name}" for x in ("w", "p2", "p4", "p5"))
    hashed = lambda a, b: F.xxhash64(a, b)
    shifted = lambda c, by: F.slice(c, by + 1, F.greatest(F.size(c), F.lit(1)))
    words = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    df = df.withColumn(p2, F.zip_with(w, shifted(w, 1), hashed))
    df = df.withColumn(p4, F.zip_with(p2, shifted(p2, 2), hashed))
    df = df.withColumn(p5, F.zip_with(p4, shifted(w, 4), hashed))
    # The last four entries of p5 lack words; a short text keeps its first, which has them all.
    count = F.when(F.size(w) == 0, 0).otherwise(F.greatest(F.size(w) - (WORDS - 1), F.lit(1)))
    shingles = F.transform(F.slice(p5, F.lit(1), count), lambda x: F.shiftrightunsigned(x, 64 - HASH_BITS))
    return df.withColumn(name, bottom(F.array_distinct(shingles))).drop(w, p2, p4, p5)


def bottom(hashes: Column) -> Column:
    return F.slice(F.sort_array(hashes), 1, K)


def merged(a, b) -> Column:
    """The sketch of two parts together."""
    return bottom(F.array_union(a, b))


def merge_agg(df: DataFrame, by: list[str], sketch: str) -> DataFrame:
    """One sketch per group: its K smallest distinct hashes.  A window would hold whole groups;
    the hashes are made distinct and ranked with a limit on each side of the shuffle."""
    single = df.select(*by, F.explode(sketch).alias("h")).distinct()
    ranked = single.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= K)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def resemblance(a: str, b: str, df: DataFrame, name: str) -> DataFrame:
    """df with the estimated Jaccard similarity of two sketches."""
    u = f"_u_{name}"
    df = df.withColumn(u, merged(a, b))
    both = F.size(F.array_intersect(F.array_intersect(u, a), b))
    return df.withColumn(name, F.when(F.size(u) == 0, 1.0).otherwise(both / F.size(u))).drop(u)


def distinct_shingles(sketch) -> Column:
    """Exact below K, else estimated from the largest kept hash."""
    n = F.size(sketch)
    return F.when(n < K, n.cast("double")).otherwise(F.lit(float(K - 1)) * float(1 << HASH_BITS) / F.element_at(sketch, -1))


def containment(a: str, b: str, df: DataFrame, name: str) -> DataFrame:
    """df with the estimated share of a's shingles that b has; 1.0 if a has none."""
    df = resemblance(a, b, df, "_j")
    shared = F.col("_j") / (1 + F.col("_j")) * (distinct_shingles(a) + distinct_shingles(b))
    return df.withColumn(name, F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a)))).drop("_j")


def encoded(sketch) -> Column:
    return F.base64(F.unhex(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), HASH_BITS // 4, "0")), "")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, sketch, fingerprint) of whole texts, without a shuffle."""
    df = with_sketch(docs.select("doc_id", common.text_of(docs).alias("text")), "text", "sketch")
    return df.select("doc_id", "sketch", encoded("sketch").alias("fingerprint"))


def listed(values: list, kind: str) -> Column:
    """Many numbers as one array literal, which Spark folds from their text."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def id_bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above the id, by binary search; null goes to bucket 0."""
    size = 1
    while size <= len(bounds):
        size *= 2
    padded = listed([*bounds, *[(1 << 63) - 1] * (size - len(bounds))], "long")
    steps = [1 << i for i in reversed(range(size.bit_length() - 1))] or [0]
    find = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.element_at(padded, F.greatest(at + step, F.lit(1))) <= doc_id, at + step).otherwise(at))
    return find if bounds else F.lit(0)


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """(bucket, extra, doc_id, text, next_text): each document beside the next by descending doc_id.

    Ids are cut at their quantiles into buckets, and each bucket also gets the first row
    of the next one (extra = 1), so texts are shuffled once and no task sees all rows.
    After the last document comes the first.  Ties of doc_id are ordered by text.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", common.text_of(docs).alias("text"))
    n = min(MOST_BUCKETS, max(docs.count() // ROWS_PER_BUCKET, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shares = listed([i / n for i in range(1, n)], "double")
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 20 * n)).first()[0] or []
    placed = docs.withColumn("bucket", id_bucket(docs["doc_id"], sorted(set(cuts))))
    heads = sorted((r["bucket"], r["head"]) for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())  # a row per bucket
    after = [(heads[i][0], heads[i - 1][1]) for i in range(len(heads))]  # bucket i goes on with the head of i - 1, the lowest with the highest
    nexts = spark.createDataFrame(after, "bucket int, head long")
    extra = docs.join(F.broadcast(nexts), docs["doc_id"].eqNullSafe(nexts["head"])).select("doc_id", "text", "bucket", F.lit(1).alias("extra"))
    window = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), "text")
    rows = placed.withColumn("extra", F.lit(0)).unionByName(extra)
    return rows.withColumn("next_text", F.lead("text").over(window)), window


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""
    rows, window = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.length("text") - half)
    rows = rows.withColumn("edited", F.concat(kept, F.coalesce(F.substring("next_text", F.lit(1), half), F.lit(""))))
    rows = with_sketch(with_sketch(rows, "text", "sketch"), "edited", "edited_sketch")
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(window)).where("extra = 0")
    rows = resemblance("sketch", "next_sketch", resemblance("sketch", "edited_sketch", rows, "near_edited"), "near_next")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        encoded("sketch").alias("fingerprint"),
        encoded("edited_sketch").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(common.table(spark, sf_dir, "documents"))
