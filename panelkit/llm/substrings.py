"""Substring dedup: a count-min prefilter, then exact grouping of what it cannot rule out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.session import cut_lineage

from .columns import WORD, free_name, read
from .sketches import PART, Parts, share
from .textarrays import Block, blocks, mix
from .workers import short_batches, tidy

#: Words of a window.
WINDOW = 50
#: Bytes of text handled as one block of arrays.
BLOCK = 1 << 18
#: The sketch: rows, and cells of a row as a power of two. Its bitmap has DEPTH * 2**LOG_CELLS bits, 64 MB.
DEPTH, LOG_CELLS = 2, 28
#: Suspected windows a task merges before it sends their smallest ids.
MERGED = 1 << 17
#: The filters of windows found in several documents and of documents that lose words, as powers of two: 16 and 8 MB.
LOG_FOUND, LOG_TOUCHED = 27, 26


def _windows(block: Block, size: int):
    """Of each window, once for each text: place (number of its first word in the text), text, and two hashes."""
    first = block.first_word()
    at, a = block.window_hash(block.word_hash(0), size, 0)
    b = block.window_hash(block.word_hash(1), size, 1)[1]
    doc = block.doc[at]
    kept = np.sort(np.unique(mix(a + mix(doc.astype(np.uint64))), return_index=True)[1])
    return at[kept] - first[doc[kept]], doc[kept], a[kept], b[kept]


def _short(b: np.ndarray) -> np.ndarray:
    """The upper half of the second hash."""
    return (b >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _known(batch, block: Block) -> np.ndarray:
    """Texts of the block that have an id."""
    return ~batch.column("doc_id").slice(block.first, block.texts).is_null().to_numpy(zero_copy_only=False)


def sketch_parts(docs: DataFrame, size: int, depth: int, log_cells: int) -> DataFrame:
    """Parts of the count-min sketch of windows; a window counts once for each text."""

    @tidy
    def sketch(batches):
        parts = Parts(depth, log_cells)
        for batch in batches:
            for block in blocks(batch.column("text"), limit=BLOCK):
                _, doc, a, b = _windows(block, size)
                kept = _known(batch, block)[doc]
                yield from parts.add(a[kept], b[kept])
        yield from parts.flush()

    return docs.select("doc_id", "text").mapInArrow(sketch, PART)


def _suspected(batches, size: int, bits, found=None):
    """Hashes, id and place of the windows that the sketch, and the filter ``found``, do not rule out, block by block."""
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column("text"), limit=BLOCK):
            place, doc, a, b = _windows(block, size)
            ok = np.flatnonzero(_known(batch, block)[doc])
            ok = ok[bits.value.may_hold(a[ok], b[ok])]
            if found is not None:
                ok = ok[found.value.may_hold(a[ok], mix(_short(b[ok]).astype(np.uint64)))]
            if len(ok):
                yield a[ok], _short(b[ok]), ids[block.first + doc[ok]], place[ok]


def document_ends(docs: DataFrame, bits, size: int) -> DataFrame:
    """``a, b`` (96 bits of hash) of suspected windows with the smallest and the largest id among those that a task
    holds at a time."""

    def ends(held):
        a, b, doc = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
        order = np.lexsort((doc, b, a))
        a, b, doc = a[order], b[order], doc[order]
        head = np.ones(len(a), bool)
        head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        last = np.append(head[1:], True)
        columns = [pa.array(a[head].view(np.int64)), pa.array(b[head]), pa.array(doc[head]), pa.array(doc[last])]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "least", "most"])

    @tidy
    def emit(batches):
        held, n = [], 0
        for part in _suspected(batches, size, bits):
            held.append(part)
            n += len(part[0])
            if n >= MERGED:
                yield ends(held)
                held, n = [], 0
        if n:
            yield ends(held)

    return docs.select("doc_id", "text").mapInArrow(emit, "a long, b int, least long, most long")


def occurrences(docs: DataFrame, bits, found, size: int) -> DataFrame:
    """``a, b, doc_id, place`` of the windows that both bitmaps may hold, each once for each text."""

    @tidy
    def emit(batches):
        for a, b, doc, place in _suspected(batches, size, bits, found):
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b), pa.array(doc), pa.array(place.astype(np.int32))], ["a", "b", "doc_id", "place"])

    return docs.select("doc_id", "text").mapInArrow(emit, "a long, b int, doc_id long, place int")


def repeated_windows(docs: DataFrame, size: int = WINDOW, depth: int = DEPTH, log_cells: int = LOG_CELLS) -> DataFrame:
    """``doc_id`` and ``places, checks``: windows that also start in a document with a smaller id, by the place where
    they first start and half a hash. Documents without any are left out; rows without an id neither lose words nor
    make others lose any.

    Tasks send cells of windows, which merge into one bitmap of cells hit twice. What it rules out occurs once. The
    rest is grouped exactly: smallest and largest id of each window, tasks sending one row a window; windows of
    several documents are written. A join gives the smallest id to every occurrence: both sides are plain shuffles,
    so a passage that a third of all documents share is a key that Spark can split.
    """
    bits = share(sketch_parts(docs, size, depth, log_cells), depth, log_cells, "again")
    groups = document_ends(docs, bits, size).groupBy("a", "b").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    several = cut_lineage(groups.filter("least < most").select("a", "b", "least"), "windows")

    @tidy
    def keys(batches):
        parts = Parts(1, LOG_FOUND)
        for batch in batches:
            yield from parts.add(batch.column("a").to_numpy().view(np.uint64), mix(batch.column("b").to_numpy().astype(np.uint64)))
        yield from parts.flush()

    found = share(several.select("a", "b").mapInArrow(keys, PART), 1, LOG_FOUND, "seen")
    met = occurrences(docs, bits, found, size).join(several, ["a", "b"]).filter("least < doc_id")
    pair = F.struct("place", F.col("b").alias("check"))
    listed = met.groupBy("doc_id").agg(F.collect_list(pair).alias("p"))  # of one document
    return listed.select("doc_id", F.col("p.place").alias("places"), F.col("p.check").alias("checks"))


def _covered(first: np.ndarray, hashes, text: int, places: np.ndarray, checks: np.ndarray, size: int) -> np.ndarray:
    """Which words of a text are covered by the windows that start at ``places`` with these checks, wherever else in
    the text the same windows start. Places of another text under the same id fail the check."""
    at, a, b = hashes
    low, high = np.searchsorted(at, first[text : text + 2])
    own_a, own_b, start = a[low:high], b[low:high], at[low:high] - first[text]
    places, checks = places[places < len(start)], checks[places < len(start)]
    good = places[_short(own_b[places]) == checks]
    hit = start[np.isin(own_a, own_a[good])]
    edges = np.zeros(first[text + 1] - first[text] + 1, np.int64)
    edges[: len(start)][hit] += 1
    np.add.at(edges, hit + size, -1)
    return np.cumsum(edges[:-1]) > 0


def dedup_substrings(docs: DataFrame, size: int = WINDOW, depth: int = DEPTH, log_cells: int = LOG_CELLS) -> DataFrame:
    """``docs`` with repeated words cut from ``text``, and ``n_words``, ``n_removed`` (underscores are added to these
    names where taken). Kept words and the white space behind them stay as they are; a text that loses nothing is
    unchanged. Every row stays, if with an empty text; a null text stays null and has no words.

    Texts that lose words are found by a small filter, and only they are joined to their windows.
    """
    short_batches(docs.sparkSession)
    windows = cut_lineage(repeated_windows(docs, size, depth, log_cells), "repeated")

    @tidy
    def ids_of(batches):
        parts = Parts(1, LOG_TOUCHED)
        for batch in batches:
            key = mix(batch.column("doc_id").to_numpy().view(np.uint64))
            yield from parts.add(key, key)
        yield from parts.flush()

    touched = share(windows.select("doc_id").mapInArrow(ids_of, PART), 1, LOG_TOUCHED, "seen")
    names = docs.columns
    n_words, n_removed = free_name(docs, "n_words"), free_name(docs, "n_removed")
    places, checks = (free_name(docs, x) for x in ("window_places", "window_checks"))
    out = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())])
    text_at, id_at = names.index("text"), names.index("doc_id")

    def may_lose(batch) -> np.ndarray:
        ids = batch.column(id_at).cast(pa.int64())
        key = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
        return touched.value.may_hold(key, key) & ~ids.is_null().to_numpy(zero_copy_only=False)

    @tidy
    def losing(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_lose(batch)))

    @tidy
    def whole(batches):
        for batch in batches:
            kept = batch.filter(pa.array(~may_lose(batch)))
            for block in blocks(kept.column(text_at), limit=BLOCK):
                columns = kept.slice(block.first, block.texts).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(block.words_per_text), pa.array(np.zeros(block.texts, np.int64))], out.names)

    lost = windows.select(F.col("doc_id").alias("window_doc"), F.col("places").alias(places), F.col("checks").alias(checks))
    hit = docs.mapInArrow(losing, docs.schema).join(lost, F.col("doc_id") == F.col("window_doc"), "left")
    columns = [*[F.col(f"`{c}`") for c in names], F.col(places), F.col(checks)]

    def cut_text(block: Block, first: int, text: int, gone: np.ndarray) -> str:
        opens = np.flatnonzero(gone & ~np.append(False, gone[:-1]))
        closes = np.flatnonzero(gone & ~np.append(gone[1:], False)) + 1
        parts, at, stop = [], block.bounds[text], block.bounds[text + 1]
        for a, b in zip(opens, closes, strict=True):
            parts.append(block.body[at : block.start[first + a]].tobytes())
            at = block.start[first + b] if b < len(gone) else stop
        return b"".join([*parts, block.body[at:stop].tobytes()]).decode("utf-8")

    @tidy
    def cut(batches):
        for batch in batches:
            for block in blocks(batch.column(text_at), limit=BLOCK):
                rows = batch.slice(block.first, block.texts)
                removed = np.zeros(block.texts, np.int64)
                column, changed = rows.column(text_at), {}
                listed = np.flatnonzero(~rows.column(len(names)).is_null().to_numpy(zero_copy_only=False))
                first = block.first_word()
                if len(listed):
                    start, a = block.window_hash(block.word_hash(0), size, 0)
                    hashes = start, a, block.window_hash(block.word_hash(1), size, 1)[1]
                for row in listed:
                    own = [rows.column(len(names) + k)[row].values.to_numpy() for k in (0, 1)]
                    gone = _covered(first, hashes, row, *own, size)
                    removed[row] = gone.sum()
                    if removed[row]:
                        changed[row] = cut_text(block, first[row], row, gone)
                if changed:
                    texts = column.to_pylist()
                    for row, text in changed.items():
                        texts[row] = text
                    column = pa.array(texts, column.type)
                columns = [column if k == text_at else rows.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(block.words_per_text), pa.array(removed)], out.names)

    # rows that lose nothing pass one worker, once: no task has two workers at a time
    return hit.select(*columns).mapInArrow(cut, out).unionByName(docs.mapInArrow(whole, out))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    cut = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)), " ")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))
