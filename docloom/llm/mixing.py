"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of its id and text, cut into cells of 10, 20 and 30
bits.  Words are summed by source and coarse cell; the cell in which a source's
budget is crossed is refined by summing only its own rows by finer cells, twice.
The budgets are nested prefixes of the hash range, so a document is taken by
comparing its hash with its source's threshold: nothing is sorted.  Sums are
combined map-side, so a source with a third of all rows is not gathered anywhere.

Sources by code point, null last, weigh 3, 1, 2, repeating.  Targets fill up by
weight until twice a source's size, the excess reshared among the others.  A target
of 1.3 sizes takes every document once and 0.3 of the words again.

A null text has size 0, takes 0 words and is chosen like any other, at most CAP times;
a null source is a source; a source without words takes none of its rows.  Repeated rows are chosen together.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import common

RATIO, CAP, WEIGHTS = 1.5, 2, (3, 1, 2)
BITS, LEVELS = 10, 3
#: Up to so many sources, about 100 bytes each, their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def sized(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, source or the columns to keep, size, cell): words and 30-bit hash cell of each document."""
    text = common.text_of(docs)
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    name = F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), text)
    cell = F.shiftrightunsigned(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), 2)
    return docs.select(*(keep or ["doc_id", "source"]), words.cast("long").alias("size"), cell.alias("cell"))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source."""
    by_name, by_fill = Window.orderBy(F.col("source").isNull(), "source"), Window.orderBy("fill", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1))
    weighed = weighed.withColumn("most", F.lit(CAP) * F.col("source_size")).withColumn("fill", F.col("most") / F.col("weight"))
    weighed = weighed.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    weighed = weighed.withColumn("full_before", F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("most"))
    weighed = weighed.withColumn("weight_left", F.col("weights") - F.sum("weight").over(by_fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("weight"))
    weighed = weighed.withColumn("level", (F.lit(RATIO) * F.col("total") - F.col("full_before")) / F.col("weight_left"))
    full = F.col("most") <= F.col("weight") * F.col("level")
    weighed = weighed.withColumn("last_level", F.max(F.when(~full, F.col("level"))).over(everything))
    target = F.when(full, F.col("most").cast("double")).otherwise(F.col("weight") * F.col("last_level"))
    return weighed.select("source", "source_size", target.alias("target"))


def _with_source(rows: DataFrame, sources: DataFrame, few: bool, *more) -> DataFrame:
    right = sources.withColumnRenamed("source", "of_source")
    on = rows["source"].eqNullSafe(right["of_source"])
    for c in more:
        on = on & c
    return rows.join(F.broadcast(right) if few else right, on).drop("of_source")


def thresholds(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """(source, source_size, target, passes, threshold): whole takes of every document, and the cell below which one more is taken."""
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    asked = sources.withColumn("passes", F.floor(share)).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    found = asked.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        rest = BITS * (LEVELS - 1 - level)
        inside = _with_source(rows, found, few, F.shiftrightunsigned(rows["cell"], rest + BITS) == F.col("prefix"))
        bins = inside.groupBy("source", "budget", "below", F.shiftrightunsigned("cell", rest).alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.col("below") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))  # at most 1024 bins a source
        crossed = bins.withColumn("upto", upto).where(F.col("upto") > F.col("budget"))
        first = F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "upto"))
        found = common.settled(crossed.groupBy("source", "budget").agg(first.alias("x")).select("source", "budget", F.col("x.bin").alias("prefix"), F.col("x.before").alias("below"), F.col("x.upto").alias("upto")))
    nearer = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("below"))
    # A source with nothing left to take after whole takes has no row above them, empty texts included.
    threshold = F.when(F.col("budget") > 0, F.col("prefix") + nearer.cast("long")).otherwise(F.lit(0).cast("long"))
    cut = found.select(F.col("source").alias("of_source"), threshold.alias("threshold"))
    # A source without words crosses nothing and takes nothing.
    return asked.join(cut, F.col("source").eqNullSafe(F.col("of_source")), "left").select("source", "source_size", "target", "passes", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def plan(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Each source's thresholds from sized rows; whether the table is small enough to broadcast."""
    sources = common.settled(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    few = sources.count() <= BROADCAST_SOURCES
    return common.settled(thresholds(rows, sources, few)), few


def takes() -> Column:
    return F.col("passes") + (F.col("cell") < F.col("threshold")).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, takes) for every row of docs; takes: how often the mix has the row."""
    rows = common.settled(sized(docs))
    cuts, few = plan(rows)
    return _with_source(rows, cuts, few).select("doc_id", "size", "source_size", "target", (takes() * F.col("size")).alias("taken"), takes().alias("takes"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them; texts are not shuffled."""
    cuts, few = plan(common.settled(sized(docs, ["source"])))
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))  # no clash with the names used here
    again = _with_source(sized(packed, ["source", "_row"]), cuts, few).withColumn("_take", F.explode(F.array_repeat(F.lit(0), takes().cast("int"))))
    return again.select("_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


#: {docs}: the relation to mix.  The cells are the same 30 bits, cut where words are nearest to the budget.
MIX_SQL = r"""
sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 8))::bigint >> 2 as cell
  from {docs}
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as k from sized group by source
), weighed as (
  select *, [3, 1, 2][(k - 1) % 3 + 1] as weight, 2 * source_size as most, 2 * source_size / [3, 1, 2][(k - 1) % 3 + 1] as fill,
         sum(source_size) over () as total from sources
), filled as (
  select *, (1.5::double * total - (sum(most) over up - most)) / (sum(weight) over () - sum(weight) over up + weight) as level
  from weighed window up as (order by fill, k rows unbounded preceding)
), aimed as (
  select source, source_size, case when most <= weight * level then most::double
         else weight * max(case when most > weight * level then level end) over () end as target from filled
), asked as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from aimed
), budgets as (
  select *, target - passes * source_size as budget from asked
), cells as (
  select source, cell, sum(sum(size)) over (partition by source order by cell) as upto, sum(size) as words from sized group by source, cell
), cuts as (
  select c.source, min_by(case when c.upto - b.budget < b.budget - (c.upto - c.words) then c.cell + 1 else c.cell end, c.cell) as threshold
  from cells c join budgets b on c.source is not distinct from b.source where c.upto > b.budget and b.budget > 0 group by c.source
), mixed as (
  select s.doc_id, s.size, b.source_size, b.target, (b.passes + (s.cell < coalesce(c.threshold, 0))::bigint) as takes
  from sized s join budgets b on s.source is not distinct from b.source left join cuts c on s.source is not distinct from c.source
)"""
ORACLE = "with " + MIX_SQL.replace("{docs}", "documents") + " select doc_id, size, source_size, target, takes * size as taken, takes from mixed"
