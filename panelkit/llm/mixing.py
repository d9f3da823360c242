"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import cut_lineage

from .columns import free_name, read, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the whole mix, as a share of all words.
SHARE = 1.5
#: Most passes over a source.
PASSES = 2
#: Hex digits of the shuffle key that cut a source into slices: 4,096 slices for each source.
SLICE_DIGITS = 3
#: Bands of finish time for each unit of it.
BANDS = 8192


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``source, source_size`` -> the same with ``weight, target``.

    Targets are in proportion to the weights, stop at ``passes`` times the size, and the excess goes to the
    others by weight: each is min(passes * size, level * weight) for one level. Sources are few; this is one task.
    A null source is a source of its own, last in order.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1)
    placed = sizes.withColumn("place", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    capped = placed.withColumn("weight", pick).withColumn("most", F.col("source_size") * F.lit(float(passes)))
    capped = capped.withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", "place")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    leveled = capped.withColumn("level", (everything * F.lit(share) - before) / rest)
    level = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(
        Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("level") < F.col("ratio"), level * F.col("weight")).otherwise(F.col("most"))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def fair_queue(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: str = "mix-1:",
) -> DataFrame:
    """``doc_id, source, size`` (and ``tie``, any column that tells rows of one doc_id apart) -> one row for each
    document and pass: ``pass, source_size, target, finish, taken`` added.

    Documents of a source stand in the order of a hash of their id. A document's finish time is the words of its
    source up to and with it, earlier passes included, over the source's target. All rows are ordered by finish
    time; those whose running total stays within the budget are taken.

    Running totals are made in slices of the key: totals of slices are added up per source, and only a slice is
    ever ordered in one task, so a source with most rows costs no more than others. The cut is found the same
    way: total words per band of finish time, then an exact order within the one band that the budget ends in.

    Rows with size 0 or null are taken for 0 words. Rows equal in all four columns are interchangeable.
    """
    docs = docs.withColumn("size", F.coalesce("size", F.lit(0)).cast("long")).withColumn("key", shuffle_key(F.col("doc_id"), seed))
    docs = docs.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = cut_lineage(docs.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    sources = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, passes)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("offset", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0))).drop("slice_size")
    offsets = offsets.alias("o").join(sources.alias("s"), F.expr("o.source <=> s.source")).select("o.*", "source_size", "target")

    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    queued = docs.withColumn("run", F.sum("size").over(within)).alias("d")
    queued = queued.join(offsets.alias("o"), F.expr("d.source <=> o.source and d.slice = o.slice"))
    queued = queued.select("d.*", "offset", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    words = F.col("pass") * F.col("source_size") + F.col("offset") + F.col("run")
    queued = queued.withColumn("finish", F.when(F.col("target") > 0, words / F.col("target")).otherwise(F.lit(0.0)))
    # a source is finished for good at passes * size / target; beyond 2 nothing is ever taken, as 1 uses up the budget
    queued = queued.withColumn("band", F.floor(F.least("finish", F.lit(2.0)) * BANDS).cast("int")).drop("offset", "run", "slice")
    queued = cut_lineage(queued, "queued")

    bands = queued.groupBy("band").agg(F.sum("size").alias("band_size"))
    bands = bands.withColumn("before", F.sum("band_size").over(Window.orderBy("band")) - F.col("band_size"))
    budget = sources.agg((F.sum("source_size") * F.lit(share)).alias("budget"))
    edge = bands.join(F.broadcast(budget), F.expr("before <= budget and budget < before + band_size"))  # one row or none
    edge = edge.agg(F.max("band").alias("edge"), F.max(F.col("budget") - F.col("before")).alias("left"))
    queued = queued.join(F.broadcast(edge), F.lit(True))  # one row
    order = Window.partitionBy("band").orderBy("finish", "pass", "key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    last = queued.filter(F.col("band") == F.col("edge"))
    last = last.withColumn("taken", F.sum("size").over(order) <= F.col("left"))
    others = queued.filter(F.col("edge").isNull() | (F.col("band") != F.col("edge")))
    others = others.withColumn("taken", F.col("edge").isNull() | (F.col("band") < F.col("edge")))
    return others.unionByName(last).drop("edge", "left", "band")


def sized(docs: DataFrame) -> DataFrame:
    """The columns ``fair_queue`` reads, from documents; ``tie`` is a hash of the text."""
    return docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("tie"))


def mix_documents(docs: DataFrame, ordered: bool = False, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    ``ordered`` sorts all rows by finish time, at the cost of one more shuffle of the texts. Documents without
    words are taken once if their turn comes within the budget.
    """
    row = free_name(docs, "mix_row")
    kept = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()), "mix")
    narrow = kept.select("doc_id", "source", word_count().alias("size"), F.col(row).alias("tie"))
    taken = fair_queue(narrow, **options).filter("taken").filter("size > 0 or pass = 0")
    finish = free_name(docs, "mix_finish")
    mixed = kept.join(taken.select(F.col("tie").alias(row), F.col("finish").alias(finish)), row)
    if ordered:
        mixed = mixed.orderBy(finish, row)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_source_mix(spark, sf_dir: str) -> DataFrame:
    return taken_words(read(spark, sf_dir, "documents"))


def taken_words(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, one row for each row of ``docs``: rows of one id, or without an id, are
    documents of their own. Null and empty texts have size 0."""
    rows = sized(docs).withColumn("tie", F.monotonically_increasing_id())
    taken = F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken")
    per_row = fair_queue(cut_lineage(rows, "sized")).groupBy("tie").agg(
        F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), taken,
    )
    return per_row.drop("tie")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, row_number() OVER () AS tie
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sources
), capped AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS ratio FROM weighted
), leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
    - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped
), targets AS (
  SELECT source, source_size, CASE WHEN level < ratio
    THEN max(CASE WHEN level < ratio THEN level END) OVER () * weight ELSE most END AS target
  FROM leveled
), queued AS (
  SELECT d.doc_id, d.size, d.key, d.tie, t.source_size, t.target, p.pass,
    (p.pass * t.source_size + sum(d.size) OVER (PARTITION BY d.source, p.pass ORDER BY d.key, d.doc_id NULLS FIRST, d.size, d.tie
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / t.target AS finish
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) AS p(pass)
), cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, pass, key, doc_id NULLS FIRST, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM queued
)
SELECT max(doc_id) AS doc_id, max(size) AS size, max(source_size) AS source_size, max(target) AS target,
  CAST(sum(CASE WHEN run <= (SELECT sum(source_size) * 1.5::DOUBLE FROM sources) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM cut GROUP BY tie
"""
