"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.session import cut_lineage

from .columns import read
from .textarrays import Block, blocks, mix

#: Buckets of n-grams, and the most words of one.
LOG_BUCKETS, GRAMS = 16, 2
#: Labelled target documents the target model is made of at most, those with the lowest hash of their id.
SAMPLE = 20_000
#: Bins of one round of the search for the k-th key; each round looks into one bin of the round before.
BINS, SEARCHES = 4096, 3


def gram_buckets(block: Block, grams: int = GRAMS, log_buckets: int = LOG_BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every run of 1 to ``grams`` words."""
    words = block.word_hash()
    docs, buckets = [], []
    for size in range(1, grams + 1):
        at, hashes = block.window_hash(words, size)
        docs.append(block.doc[at])
        buckets.append((mix(hashes + np.uint64(size)) >> np.uint64(64 - log_buckets)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(buckets)


def bucket_counts(docs: DataFrame, log_buckets: int = LOG_BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; a task sends one row a bucket, the driver gets 2**log_buckets."""

    def count(batches):
        total = np.zeros(1 << log_buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                total += np.bincount(gram_buckets(block, log_buckets=log_buckets)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << log_buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the target's over the raw text's share of each bucket, one added to every count."""
    share = lambda n: np.log(n + 1.0) - np.log(n.sum() + len(n))
    return share(target) - share(raw)


def target_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(good), "doc_id")  # at most ``sample`` ids


def importance(docs: DataFrame, ratios: np.ndarray, seed: int = 1) -> DataFrame:
    """``doc_id, n_grams, log_weight, key``: the log of a text's target over raw likelihood, and the same plus Gumbel
    noise drawn from a hash of the id. A text without words has weight 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    log_buckets = int(np.log2(len(ratios)))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())])

    def weigh(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                doc, bucket = gram_buckets(block, log_buckets=log_buckets)
                order = np.argsort(doc, kind="stable")  # one order of addition for each text, wherever it is cut
                weight = np.bincount(doc[order], shared.value[bucket[order]], block.texts).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, block.texts), pa.array(np.bincount(doc, minlength=block.texts)), pa.array(weight, pa.float64())],
                    schema.names,
                )

    weighed = docs.select("doc_id", "text").mapInArrow(weigh, schema)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def top_k(keyed: DataFrame, k: int, kept: str = "kept") -> DataFrame:
    """``keyed`` with ``kept``: whether a row's ``key`` is among the ``k`` highest, ties by doc_id.

    The k-th key is closed in by counts over bins of the range it must lie in; only its last bin is ordered.
    """
    low, high = keyed.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return keyed.withColumn(kept, F.lit(False))
    above = 0
    for _ in range(SEARCHES):
        width = (high - low) / BINS
        if width <= 0:
            break
        inside = keyed.filter(F.col("key").between(low, high))
        bins = inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):  # BINS rows at most
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
        else:
            return keyed.withColumn(kept, F.lit(True))  # fewer rows than k
    edge = keyed.filter(F.col("key").between(low, high))
    edge = edge.withColumn(kept, F.row_number().over(Window.orderBy(F.desc("key"), "doc_id")) <= k - above)
    return keyed.filter(~F.col("key").between(low, high)).withColumn(kept, F.col("key") > high).unionByName(edge)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, sample: int = SAMPLE, seed: int = 1) -> DataFrame:
    """``doc_id, n_grams, log_weight, key, kept`` for each row: the ``k`` rows that importance resampling without
    replacement draws. ``k`` is by default the labels' share of good documents, of all rows; without labels, all."""
    ratios = log_ratios(bucket_counts(target_documents(docs, labels, sample)), bucket_counts(docs))
    keyed = cut_lineage(importance(docs, ratios, seed), "importance")
    if k is None:
        share = labels.filter("quality is not null").agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))).first()[0]
        k = round((1.0 if share is None else share) * keyed.count())
    return top_k(keyed, k)


def op3_quality_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
