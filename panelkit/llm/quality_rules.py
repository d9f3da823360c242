"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Trees, fit
from .columns import read
from .textarrays import Block, blocks, mix, per_text

#: Labelled documents the trees are fitted on at most, those with the lowest hash of their id.
SAMPLE = 20_000
#: Documents the trees give at least this chance of being good are kept.
KEEP_FROM = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: Counts of a text, in output order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the trees see, and how the chance of being good may go with it.
FEATURES = {
    "words": 0, "chars_per_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeated": -1, "distinct": 0,
    "upper": 0, "digits": 0, "words_per_line": 0, "longest_word": 0, "high_bytes": 0, "punctuation": 0,
}


def block_statistics(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Counts and features of each text of a block."""
    body, n_texts = block.body, block.texts
    owner = np.repeat(np.arange(n_texts), np.diff(block.bounds))

    def per_byte(flag: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flag], minlength=n_texts)

    words = block.words_per_text
    points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
    length = points[block.end] - points[block.start]
    word_chars = np.bincount(block.doc, length, n_texts).astype(np.int64)
    longest = np.zeros(n_texts, np.int64)
    np.maximum.at(longest, block.doc, length)
    symbols = per_byte(_SYMBOL[body])

    breaks = np.zeros(len(body) + 1, bool)
    breaks[block.bounds] = True
    breaks[1:] |= body == 10
    line_start = np.flatnonzero(breaks[:-1])
    line_end = np.append(line_start[1:], len(body))
    line_end = line_end - ((line_end > line_start) & (body[np.maximum(line_end - 1, 0)] == 10)) if len(line_start) else line_end
    word_starts = np.searchsorted(block.start, line_start), np.searchsorted(block.start, line_end)
    full = word_starts[1] > word_starts[0]
    line_start, line_end = line_start[full], line_end[full]
    line_doc = np.searchsorted(block.bounds, line_start, "right") - 1
    line_key = mix(block.byte_hash(line_start, line_end) + mix(line_doc.astype(np.uint64)))
    first = np.unique(line_key, return_index=True)[1]
    lines = np.bincount(line_doc, minlength=n_texts)
    dup_lines = lines - np.bincount(line_doc[first], minlength=n_texts)

    hashes = block.word_hash()
    at, window = block.window_hash(hashes, 3)
    repeat_words = np.zeros(n_texts, np.int64)
    if len(at):
        key = mix(window + mix(block.doc[at].astype(np.uint64)))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        start = at[count[which] > 1]
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + 3, -1)
        repeat_words = per_text(block, np.flatnonzero(np.cumsum(cover[:-1]) > 0))
    own = np.unique(mix(hashes + mix(block.doc.astype(np.uint64))), return_index=True)[1]
    distinct = per_text(block, own)

    some, size = np.maximum(words, 1), np.maximum(np.diff(block.bounds), 1)
    features = np.stack([
        words, word_chars / some, symbols / some, dup_lines / np.maximum(lines, 1), repeat_words / some, distinct / some,
        per_byte((body >= 65) & (body <= 90)) / size, per_byte((body >= 48) & (body <= 57)) / size, words / np.maximum(lines, 1),
        longest, per_byte(body >= 128) / size, per_byte((body == 46) | (body == 44)) / some,
    ], 1).astype(float)
    return np.stack([words, word_chars, symbols, dup_lines, repeat_words], 1).astype(np.int64), features


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the counts and ``features`` (array of doubles) of each text; a null text is empty."""
    schema = T.StructType([
        *[docs.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in COUNTS],
        T.StructField("features", T.ArrayType(T.DoubleType())),
    ])

    def compute(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                counts, features = block_statistics(block)
                flat = pa.array(features.ravel())
                offsets = pa.array(np.arange(block.texts + 1, dtype=np.int32) * features.shape[1])
                kept = [batch.column(c).slice(block.first, block.texts) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *[pa.array(counts[:, k]) for k in range(len(COUNTS))], pa.ListArray.from_arrays(offsets, flat)], schema.names,
                )

    return docs.select(*keep, "text").mapInArrow(compute, schema)


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Trees:
    """Trees for ``labels.quality`` from at most ``sample`` labelled documents (labelled rows with null labels or ids
    aside). Only those documents' statistics are made, and only they reach the driver."""
    chosen = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` narrow rows
    rows = statistics(labelled, ("doc_id", "quality")).select("quality", "features").toPandas()
    x = np.stack(rows["features"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["quality"].to_numpy(float), tuple(FEATURES.values()), **options)


def apply_rules(docs: DataFrame, trees: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``good`` (chance by the trees) and ``kept`` for each row.

    Base rules: under 50 words, or over half of the words in three-word windows that occur twice, fail. Texts
    without words fail. ``kept`` is what passes the base rules and the trees.
    """
    made = statistics(docs)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType([*[f for f in made.schema if f.name != "features"], T.StructField("good", T.DoubleType())])

    def score(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            columns = [batch.column(c) for c in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shared.value.score(x))], schema.names)

    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    scored = made.mapInArrow(score, schema).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("good") >= keep_from))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, read(spark, sf_dir, "labels")))
