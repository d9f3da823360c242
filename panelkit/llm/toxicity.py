"""Toxic spans and scores from a linear-chain conditional random field."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chain import LOG_FEATURES, Chain, logistic
from .columns import free_name, read
from .textarrays import Block, blocks, mix
from .workers import give_back, tidy

#: Labelled documents of each class the field is fitted on at most, those with the lowest hash of their id.
SAMPLE = 1_000
#: Least weight of a labelled word.
WEIGHT = 0.7
#: Words of a chain while fitting; documents are scored as one chain each.
FIT_CHAIN = 256
#: Bytes of text whose chains step together.
BLOCK = 1 << 19
#: Chance from which a word is part of a span, and a document toxic.
TAGGED = 0.5
REJECT = 0.5

_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def word_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word without ASCII marks at its ends, and hashed features: the word, its first four and last three
    bytes, and the word before. The block's text is lower case."""
    body, n = block.body, len(block.body)
    inner = ~_EDGE[body]
    spot = np.arange(n)
    next_inner = np.minimum.accumulate(np.where(inner, spot, n)[::-1])[::-1] if n else spot
    last_inner = np.maximum.accumulate(np.where(inner, spot, -1)) if n else spot
    start = np.minimum(next_inner[block.start], block.end) if n else block.start
    end = np.maximum(last_inner[block.end - 1] + 1, start) if n else block.end
    word = block.byte_hash(start, end)
    opening, ending = block.byte_hash(start, np.minimum(start + 4, end)), block.byte_hash(np.maximum(end - 3, start), end)
    before = np.zeros_like(word)
    if len(word):
        before[1:] = np.where(block.doc[1:] == block.doc[:-1], word[:-1], np.uint64(0))
    salts = mix(np.arange(1, 5, dtype=np.uint64))
    kinds = [mix(x + salt) >> np.uint64(64 - LOG_FEATURES) for salt, x in zip(salts, (word, opening, ending, before), strict=True)]
    return word, np.stack(kinds, 1).astype(np.int64) if len(word) else np.zeros((0, 4), np.int64)


@dataclass
class Tagger:
    chain: Chain
    score_weights: np.ndarray
    #: without labels of both classes nothing is learned, and every score is 0.5
    fitted: bool = True

    def documents(self, chances: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of each document from the chances of its words."""
        return 1 / (1 + np.exp(-np.clip(self.score_weights[0] + self.score_weights[1] * _evidence(chances, first), -30, 30)))


def _evidence(chances: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log of one plus the squared chances of a document's words: many doubtful words say less than one sure word."""
    sums = np.concatenate([[0.0], np.cumsum(chances**2)])
    return np.log1p(np.maximum(sums[first[1:]] - sums[first[:-1]], 0))


def _weights(code: np.ndarray, before: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Careful estimate (two standard errors down) of the log odds of each token's code in toxic documents."""
    n = int(code.max()) + 1
    wide = int(before.max()) + 2
    bad, good = (np.bincount(np.unique(code[toxic == y].astype(np.int64) * wide + before[toxic == y] + 1) // wide, minlength=n) for y in (1, 0))
    weight = np.log((bad + 0.5) / (bad.sum() + 1)) - np.log((good + 0.5) / (good.sum() + 1))
    return (weight - 2 * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)))[code]


def labelled_tokens(words: np.ndarray, openings: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """State of each word, from labels of documents.

    A word weighs what it or its opening tells of toxic documents, counted once for each word before it, so that
    copies of one document count once. In a toxic document the words of a weight over WEIGHT and within 1.5 of its
    heaviest are labelled.
    """
    if not len(words):
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    code = np.unique(words, return_inverse=True)[1]
    before = np.append(-1, code[:-1])
    before[first[:-1][np.diff(first) > 0]] = -1
    weight = np.maximum(_weights(code, before, toxic[doc]), _weights(openings, before, toxic[doc]))
    heaviest = np.full(len(first) - 1, -np.inf)
    np.maximum.at(heaviest, doc, weight)
    return ((toxic[doc] == 1) & (weight > WEIGHT) & (weight >= heaviest[doc] - 1.5)).astype(np.int64)


def training_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``toxic, text`` of at most ``sample`` documents of each class outside the held-out fifth."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.filter("toxic = 1").orderBy(*order).limit(sample).union(known.filter("toxic = 0").orderBy(*order).limit(sample))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # 2 * sample narrow rows


def fit_tagger(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Fit on words of the sample's texts as hashes; no text reaches the driver. Without labels of both classes, all scores are 0.5."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("toxic", T.IntegerType()),
        T.StructField("words", T.BinaryType()), T.StructField("features", T.BinaryType()),
    ])

    @tidy
    def hashed(batches):
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                words, features = word_features(block)
                first = block.first_word()
                cut = [(words[a:b].tobytes(), features[a:b].astype(np.int32).tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(block.first, block.texts),
                    batch.column("toxic").slice(block.first, block.texts).cast(pa.int32()),
                    pa.array([w for w, _ in cut], pa.binary()), pa.array([f for _, f in cut], pa.binary()),
                ], schema.names)

    tagger = _fitted(training_sample(docs, labels, sample).mapInArrow(hashed, schema).toArrow())
    give_back()  # the driver lives on
    return tagger


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of all rows of a binary column, one after the other."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind)


def _fitted(rows: pa.Table) -> Tagger:
    rows = rows.take(pc.sort_indices(rows["doc_id"]))  # stable: the order of tasks must not move the sums
    toxic = rows["toxic"].to_numpy().astype(float)
    if len(np.unique(toxic)) < 2:
        return Tagger(Chain(), np.zeros(2), False)
    words, features = _joined(rows["words"], np.uint64), _joined(rows["features"], np.int32).reshape(-1, 4)
    first = np.concatenate([[0], np.cumsum(pc.binary_length(rows["words"]).to_numpy() // 8)])
    del rows  # hashes are held once
    # only for fitting, chains are cut every FIT_CHAIN words, so that a step is short
    cuts = np.unique(np.concatenate([first, *[np.arange(a, b, FIT_CHAIN) for a, b in zip(first[:-1], first[1:], strict=True)]]))
    state = labelled_tokens(words, features[:, 1], first, toxic)
    del words
    chain = Chain().fit(features, cuts, state)
    return Tagger(chain, logistic(_evidence(chain.marginals(features, first), first)[:, None], toxic))


def tag(docs: DataFrame, tagger: Tagger, score: str = "score", spans: str | None = "spans") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``spans``: runs of tagged words as code point offsets [start, end).

    One pass over whole texts, no shuffle. An empty or null text has the score of no tagged word and no spans. Underscores
    are added to the names where taken.
    """
    score, spans = free_name(docs, score), free_name(docs, spans) if spans else None
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    added = [T.StructField(score, T.DoubleType())] + ([T.StructField(spans, span)] if spans else [])
    schema = T.StructType([*docs.schema.fields, *added])
    place = docs.columns.index("text")

    @tidy
    def tagged(batches):
        own = shared.value
        for batch in batches:
            for block in blocks(batch.column(place), lower=True, limit=BLOCK):
                features = word_features(block)[1]
                first = block.first_word()
                chances = own.chain.marginals(features, first)
                columns = [c.slice(block.first, block.texts) for c in batch.columns] + [pa.array(own.documents(chances, first))]
                if spans:
                    columns.append(_spans(block, chances >= TAGGED))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(tagged, schema)


def _spans(block: Block, flagged: np.ndarray) -> pa.Array:
    hit = np.flatnonzero(flagged)
    joined = (np.diff(hit) == 1) & (np.diff(block.doc[hit]) == 0) if len(hit) else np.zeros(0, bool)
    opens, closes = hit[np.append(True, ~joined)] if len(hit) else hit, hit[np.append(~joined, True)] if len(hit) else hit
    points = np.concatenate([[0], np.cumsum((block.body & 0xC0) != 0x80)])
    shift = points[block.bounds[block.doc[opens]]]
    values = pa.StructArray.from_arrays(
        [pa.array((points[block.start[opens]] - shift).astype(np.int32)), pa.array((points[block.end[closes]] - shift).astype(np.int32))],
        ["start", "end"],
    )
    counts = np.bincount(block.doc[opens], minlength=block.texts)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT, sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` with a score under ``reject``; all rows where the labels hold less than two classes. Null and empty texts
    are scored as texts without a tagged word, repeated rows alike."""
    tagger = fit_tagger(docs, labels, sample)
    if not tagger.fitted:
        return docs
    score = free_name(docs, "toxicity")
    scored = tag(docs, tagger, score, spans=None)
    return scored.filter(F.col(score) < reject).drop(score)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = tag(docs, fit_tagger(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans",
    )
