"""Phrase collocation mining over a weighted de Bruijn graph of words.

Edges are runs of four words, nodes the runs of three they overlap in. Only edges are counted from the texts: a run that ends
sooner gives an edge with marks in place of the missing words. The count of a shorter run is the flow out of it, the sum of
the edges that begin with it, marked ends included. Paths through nodes with one way in and one way out, all of one
weight, are kept as one row with their words.

Texts are cut at words and pairs of words too rare to be part of any phrase asked for. Whatever is asked for lies within
the runs that are left, so its counts stay exact, and long tails never travel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.session import cut_lineage

from .bitmaps import bitmap, may_hold
from .columns import read
from .textarrays import mix

#: Words of an edge; phrases have up to as many.
LONGEST = 4
#: Least count of a phrase, share of its count (in hundredths) at which a longer one replaces it, phrases reported for a language.
LEAST, SHARE, TOP = 30, 80, 2000
#: Bytes of text cut into words at once; a longer text is read in pieces.
PIECE = 1 << 19
#: Words or runs a task holds before it sends their counts.
HELD = 1 << 20
#: Parts in which the phrases of a language are ranked first.
SALTS = 64

_BASE = 0xC2B2AE3D27D4EB4F
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that end a piece, and those that only end a word.
_ENDS, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK[list(b" \t")] = True
_GAP = _ENDS | _BLANK


def _powers(n: int, known: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the base and of its inverse modulo 2**64, made once in a task."""
    if not known or len(known[0]) < n:
        def run(step: int) -> np.ndarray:
            out = np.full(max(n, PIECE + 1), step, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        known[:] = [run(_BASE), run(pow(_BASE, -1, 1 << 64))]
    return known[0], known[1]


@dataclass
class Words:
    """Words of whole texts, or of a piece of one: row, hash, bounds in ``body``, and whether a piece ends behind each.
    ``opens`` tells that a piece ends before the first word, ``goes_on`` that the text has more."""

    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    last: np.ndarray
    body: np.ndarray
    opens: bool
    goes_on: bool

    def word(self, i: int) -> bytes:
        return self.body[self.start[i] : self.end[i]].tobytes()


def _words(body: np.ndarray, edges: np.ndarray, first: int, goes_on: bool) -> Words:
    body = _LOWER[body]
    inside = np.append(~_GAP[body], False)
    edge = np.zeros(len(body) + 1, bool)
    edge[edges] = True
    before = np.append(False, inside[:-1])
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    row = np.searchsorted(edges, start, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(_ENDS[body], dtype=np.int64)])
    last = np.ones(len(start), bool)
    last[:-1] = (breaks[start[1:]] > breaks[end[:-1]]) | (row[1:] != row[:-1])
    if len(start) and goes_on:
        last[-1] = breaks[-1] > breaks[end[-1]]
    power, inverse = _powers(len(body) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power[: len(body)])])
    hashes = mix((sums[end] - sums[start]) * inverse[start])
    opens = bool(breaks[start[0]] if len(start) else breaks[-1])
    return Words(row + first, hashes, start, end, last, body, opens, goes_on)


def read_words(texts: pa.Array):
    """Words of a column of texts (null: empty), A-Z lowered, in blocks of whole texts; longer texts in pieces."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + PIECE, "right")) - 1)
        at, stop = int(bounds[low]), int(bounds[high])
        if stop - at <= PIECE:
            yield _words(data[at:stop], bounds[low : high + 1] - at, low, False)
        while stop - at > PIECE:
            cut = at + PIECE
            while cut < stop and not _GAP[data[cut]]:
                ahead = np.flatnonzero(_GAP[data[cut : min(stop, cut + PIECE)]])
                cut = cut + int(ahead[0]) if len(ahead) else min(stop, cut + PIECE)
            yield _words(data[at:cut], np.array([0, cut - at]), low, cut < stop)
            at = cut
            if at < stop <= at + PIECE:
                yield _words(data[at:stop], np.array([0, stop - at]), low, False)
        low = high


def read_runs(texts: pa.Array):
    """``row, hash, last`` of the words of whole texts, long ones put together from their pieces."""
    held: list[Words] = []
    for part in read_words(texts):
        if not part.goes_on and not held:
            yield part.row, part.hash, part.last
            continue
        held.append(part)
        if not part.goes_on:
            row, hashes, last = (np.concatenate([getattr(w, c) for w in held]) for c in ("row", "hash", "last"))
            at = 0
            for w in held:
                if w.opens and at:
                    last[at - 1] = True
                at += len(w.row)
            if at:
                last[-1] = True
            held = []
            yield row, hashes, last


def prepared(docs: DataFrame) -> DataFrame:
    """``text, lang, tongue``: the language (null: ``und``) and its hash, which keeps the words of languages apart."""
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    return docs.select("text", lang.alias("lang"), F.xxhash64(lang).alias("tongue"))


def _ids(hashes: np.ndarray, row: np.ndarray, tongue: np.ndarray) -> np.ndarray:
    """Ids of words in their languages; 0 is kept for marks."""
    return np.maximum(mix(hashes + mix(tongue.view(np.uint64))[row]), np.uint64(1))


def _counts(keys: np.ndarray, weights: np.ndarray | None = None):
    """First items of each key, and how often it occurs."""
    _, first, inverse, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, n if weights is None else np.bincount(inverse, weights, len(first)).astype(np.int64)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``id, lang, word, f`` of all words."""

    def emit(batches):
        for batch in batches:
            tongue, langs = batch.column("tongue").to_numpy(), batch.column("lang")
            held, size = [], 0

            def flush():
                ids, n, row = (np.concatenate([h[k] for h in held]) for k in range(3))
                words = [w for h in held for w in h[3]]
                first, n = _counts(ids, n)
                return pa.RecordBatch.from_arrays([
                    pa.array(ids[first].view(np.int64)), langs.take(pa.array(row[first])).cast(pa.string()),
                    pa.array([words[k] for k in first], pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], ["id", "lang", "word", "c"])

            for block in read_words(batch.column("text")):
                if not len(block.row):
                    continue
                ids = _ids(block.hash, block.row, tongue)
                first, n = _counts(ids)
                held.append((ids[first], n, block.row[first], [block.word(k) for k in first]))
                size += len(first)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

    met = prepared(docs).mapInArrow(emit, "id long, lang string, word string, c long")
    return met.groupBy("id", "lang", "word").agg(F.sum("c").alias("f"))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a + mix(b ^ np.uint64(0x9E3779B97F4A7C15)))


def frequent_pairs(docs: DataFrame, words, least: int) -> DataFrame:
    """``key`` of neighbouring words, both of ``words``, that occur often enough."""

    def emit(batches):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "c"])

        for batch in batches:
            tongue = batch.column("tongue").to_numpy()
            for row, hashes, last in read_runs(batch.column("text")):
                ids = _ids(hashes, row, tongue)
                good = may_hold(words, ids)
                at = np.flatnonzero(good[:-1] & good[1:] & ~last[:-1])
                held.append(_pair(ids[at], ids[at + 1]))
                size += len(at)
                if size >= 2 * HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    met = prepared(docs).mapInArrow(emit, "key long, c int")
    return met.groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).select("key")


def edges(docs: DataFrame, words, pairs) -> DataFrame:
    """``w1, w2, w3, w4, c``: the graph's edges and their weights, 0 for what lies behind the end of a run."""
    names = ["w1", "w2", "w3", "w4"]

    def emit(batches):
        held, size = [], 0

        def flush():
            grams, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            first, n = _counts(_key(grams), n)
            return pa.RecordBatch.from_arrays([*(pa.array(grams[first, k].view(np.int64)) for k in range(LONGEST)), pa.array(n)], [*names, "c"])

        for batch in batches:
            tongue = batch.column("tongue").to_numpy()
            for row, hashes, last in read_runs(batch.column("text")):
                ids = _ids(hashes, row, tongue)
                for low in range(0, len(ids), HELD):
                    own = np.append(ids[low : low + HELD + LONGEST - 1], np.zeros(LONGEST, np.uint64))
                    on = ~last[low : low + HELD + LONGEST - 1]
                    good = may_hold(words, own[:-LONGEST])
                    on[:-1] &= good[:-1] & good[1:]
                    on[-1] = False
                    at = np.flatnonzero(on)
                    on[at] = may_hold(pairs, _pair(own[at], own[at + 1]))
                    on = np.append(on, np.zeros(LONGEST, bool))
                    at = np.flatnonzero(on[: min(HELD, len(ids) - low)])
                    two = on[at + 1]
                    three = two & on[at + 2]
                    grams = np.stack([own[at], own[at + 1], np.where(two, own[at + 2], 0), np.where(three, own[at + 3], 0)], 1).astype(np.uint64)
                    first, n = _counts(_key(grams))
                    held.append((grams[first], n))
                    size += len(first)
                if size >= HELD // 2:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    met = prepared(docs).mapInArrow(emit, ", ".join(f"{w} long" for w in names) + ", c long")
    return met.groupBy(*names).agg(F.sum("c").alias("c"))


def _key(grams: np.ndarray) -> np.ndarray:
    out = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        out = mix(out + grams[:, k])
    return out


def compact(heavy: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths ``words, f`` of edges (``w1..w4, f``), and the nodes (``w1, w2, w3, f``) that lie inside no path.

    Two edges are joined where both have the weight of the node between them: nothing else enters or leaves it. Such edges
    form no circle, as a run that stayed in one would begin or end at one of its nodes. Each edge finds the head of its
    path by doubling its pointer, so rounds grow with the logarithm of the longest path.
    """
    e = cut_lineage(heavy.withColumn("e", F.xxhash64("w1", "w2", "w3", "w4")), "edges")
    into = e.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("w4").alias("w3"), "f", F.col("e").alias("before"))
    out = e.select("w1", "w2", "w3", "f", F.col("e").alias("after"))
    inner = cut_lineage(nodes.join(into, ["w1", "w2", "w3", "f"]).join(out, ["w1", "w2", "w3", "f"]), "inner")
    steps = e.select("e").join(inner.select(F.col("after").alias("e"), "before"), "e", "left")
    known = cut_lineage(steps.select("e", F.coalesce("before", "e").alias("head"), F.col("before").isNotNull().cast("int").alias("d")), "heads")
    while True:
        jump = known.select(F.col("e").alias("head"), F.col("head").alias("next"), F.col("d").alias("more")).filter("more > 0")
        if known.join(jump, "head", "left_semi").isEmpty():
            break
        moved = known.join(jump, "head", "left")
        known = cut_lineage(moved.select("e", F.coalesce("next", "head").alias("head"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")), "heads")
    placed = e.join(known, "e")
    first = F.min_by(F.array("w1", "w2", "w3"), "d")
    rest = F.transform(F.array_sort(F.collect_list(F.struct("d", "w4"))), lambda x: x["w4"])  # of one path, no longer than a text
    paths = placed.groupBy("head").agg(F.concat(first, rest).alias("words"), F.max("f").alias("f"))
    return paths.select("words", "f"), nodes.join(inner.select("w1", "w2", "w3"), ["w1", "w2", "w3"], "left_anti")


@dataclass
class Graph:
    """``vocabulary`` (all words), ``paths`` (``words, f``), ``nodes`` and ``pairs`` with a count of ``least`` or more."""

    vocabulary: DataFrame
    paths: DataFrame
    nodes: DataFrame
    pairs: DataFrame
    least: int

    def phrases(self) -> DataFrame:
        """``words, f`` of all runs of one to four words that occur ``least`` times."""
        def windows(size: int, low: int, cut: int):
            index = F.sequence(F.lit(low), F.size("words") - size + 1 - cut)
            return F.transform(index, lambda k: F.slice("words", k, size))

        four = self.paths.select(F.explode(windows(LONGEST, 1, 0)).alias("words"), "f")
        inner = self.paths.filter(F.size("words") > LONGEST).select(F.explode(windows(LONGEST - 1, 2, 1)).alias("words"), "f")
        three = self.nodes.select(F.array("w1", "w2", "w3").alias("words"), "f")
        two = self.pairs.select(F.array("w1", "w2").alias("words"), "f")
        one = self.vocabulary.filter(F.col("f") >= self.least).select(F.array("id").alias("words"), "f")
        return four.union(inner).union(three).union(two).union(one)


def word_graph(docs: DataFrame, least: int = LEAST) -> Graph:
    """The graph of all runs of four words that occur ``least`` times, with its shorter counts."""
    known = cut_lineage(vocabulary(docs), "words")
    words = bitmap(known.filter(F.col("f") >= least).select("id"))
    pairs = bitmap(cut_lineage(frequent_pairs(docs, words, least), "pairs"))
    flow = cut_lineage(edges(docs, words, pairs), "flow")
    for shared in (words, pairs):
        shared.unpersist()
    often = F.col("f") >= least
    total = F.sum("c").alias("f")
    heavy = flow.filter((F.col("w4") != 0) & (F.col("c") >= least)).withColumnRenamed("c", "f")
    nodes = cut_lineage(flow.filter("w3 != 0").groupBy("w1", "w2", "w3").agg(total).filter(often), "nodes")
    two = cut_lineage(flow.groupBy("w1", "w2").agg(total).filter(often), "two")
    paths, outer = compact(heavy, nodes)
    return Graph(known, cut_lineage(paths, "paths"), cut_lineage(outer, "outer"), two, least)


def scored(graph: Graph, share: int = SHARE) -> DataFrame:
    """``words, a, l, r, score`` of candidates: at the cut with the least score, the shortest first part among equals. Those
    that a longer one replaces are left out. Products are decimals of 38 digits."""
    phrases = cut_lineage(graph.phrases(), "phrases")
    found = phrases.filter(F.size("words") > 1).withColumnRenamed("f", "a")
    size = F.size("words")
    cuts = found.select("words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("right"))
    part = lambda side, count: phrases.select(F.col("words").alias(side), F.col("f").alias(count))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(19, 0)) AS DECIMAL(38, 0)) DIV CAST(l + r AS DECIMAL(20, 0))")
    best = cuts.groupBy("words").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("b"))
    best = best.select("words", "b.a", "b.l", "b.r", F.col("b.score").cast("long").alias("score"))
    longer = found.filter(size > 2).select("a", size.alias("n"), "words").select("a", "words", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("k"))
    inside = longer.select("a", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("k") + 1), lambda i: F.slice("words", i, F.col("k")))).alias("words"))
    most = inside.groupBy("words").agg(F.max("a").alias("most"))
    kept = best.join(most, "words", "left")
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * by
    return kept.filter(F.col("most").isNull() | (wide("most", 100) < wide("a", share))).drop("most")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The best phrases of two to four words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a, l, r`` count the phrase and the two parts at its weakest cut, ``n`` all words of the language. Ties go by ``a``
    descending, then by the phrase's bytes. Null texts are empty, a null language is ``und``; repeated rows count as often as
    they stand. A language without a phrase that occurs ``least`` times gives no rows. Other columns are not read.
    """
    graph = word_graph(docs, least)
    best = scored(graph, share)
    frequent = graph.vocabulary.filter(F.col("f") >= least).select("id", "lang", "word")
    spelled = best.select("*", F.posexplode("words").alias("k", "id")).join(frequent, "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ")
    whole = spelled.groupBy("words", "a", "l", "r", "score").agg(F.min("lang").alias("lang"), text.alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("words"), F.lit(SALTS))
    few = whole.withColumn("rank", F.row_number().over(W.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = graph.vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
