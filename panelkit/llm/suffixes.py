"""Suffix-array dedup of bytes: suffixes that may be repeated are sorted by hash comparisons, in buckets that Spark deals out.

Every string of ``size`` bytes has an anchor, the gram with the least hash in it. Neighbouring strings with one anchor form a
strip, so equal strings meet under the hash of their anchor, and only strips whose anchor occurs again travel. Strips that
are equal as a whole are settled by their hash (with the anchor's: 128 bits). Of those left, the bytes are sent to the task
that holds their anchor, which sorts their suffixes: prefix polynomial hashes and binary search give the common extension
of two suffixes, which is a comparison in a merge sort; equal neighbours are verified byte by byte.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.session import cut_lineage

from .bitmaps import bitmap, may_hold
from .columns import free_name, read
from .textarrays import mix

#: Bytes of a string, and of a gram that may be its anchor.
SIZE, GRAM = 100, 40
#: Bytes of text scanned at once; a longer text is scanned in overlapping pieces.
PIECE = 1 << 19
#: Strips a task compares with each other before it sends the first of each kind.
HELD = 1 << 18
#: Bytes of strips sorted at once, and the most kinds of strips under one anchor for that. Beyond it strings travel one by one.
SORTED, KINDS = 1 << 20, 1 << 12

_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD1342543DE82EF95)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    def run(step: int) -> np.ndarray:
        out = np.full(n, step, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def _room(n: int) -> int:
    """Lengths are rounded up, so that few tables of powers are made."""
    return max(1 << 16, 1 << (n - 1).bit_length())


class Prefix:
    """Prefix polynomial hashes of bytes: the hash of any run of them takes two of these."""

    def __init__(self, data: np.ndarray):
        power, inverse = _powers(_room(len(data) + 1))
        self.data, self.power = data, power
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[: len(data)], out=self.sums[1:])
        self.sums *= power[: len(data) + 1]  # now: previous hash * base + byte * base

    def hash(self, at: np.ndarray, length) -> np.ndarray:
        return self.sums[at + length] - self.sums[at] * self.power[length]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Common extension of the suffixes at ``a`` and ``b``, up to ``most`` bytes, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        for _ in range(most.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hash(a, middle) == self.hash(b, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def compare(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """-1, 0 or 1 as the suffix at ``a`` sorts before, with or behind that at ``b`` by its first ``most`` bytes."""
        same = self.hash(a, most) == self.hash(b, most)
        out = np.zeros(len(a), np.int64)
        left, right = a[~same], b[~same]
        k = np.minimum(self.common(left, right, most), most - 1)
        out[~same] = np.sign(self.data[left + k].astype(np.int64) - self.data[right + k])
        return out


def suffix_sort(prefix: Prefix, starts: np.ndarray, bucket: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes ``starts`` by bucket (ascending already) and first ``most`` bytes: a stable merge sort from the
    bottom up, all runs of all buckets merged at once. A suffix finds its place in the run beside its own by binary search."""
    n = len(starts)
    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if n else np.zeros(0, np.int64)
    length = np.diff(np.append(head, n))
    begin, total = np.repeat(head, length), np.repeat(length, length)
    order, width = np.arange(n), 1
    while n and width < length.max():
        at = np.flatnonzero(total > width)
        local, first, size = at - begin[at], begin[at], total[at]
        run = local // width
        low = first + (run ^ 1) * width
        high = np.minimum(low + width, first + size)
        alone = low >= high
        at, local, first, run, low, high = (x[~alone] for x in (at, local, first, run, low, high))
        own, later, base = starts[order[at]], (run & 1) == 1, low.copy()
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(low < high)
            middle = (low[open_] + high[open_]) >> 1
            side = prefix.compare(starts[order[middle]], own[open_], most)
            behind = np.where(later[open_], side <= 0, side < 0)
            low[open_] = np.where(behind, middle + 1, low[open_])
            high[open_] = np.where(behind, high[open_], middle)
        merged = order.copy()
        merged[first + (run & ~1) * width + (local - run * width) + (low - base)] = order[at]
        order, width = merged, width * 2
    return order


def equal_strings(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, size: int) -> np.ndarray:
    """Number of the class of each string ``data[start:start + size]``: equal ones of a bucket share it.

    Neighbours in the sorted order with equal hashes are compared byte by byte. Where hashes collided, the bucket is
    classed by its bytes.
    """
    by_bucket = np.argsort(bucket, kind="stable")
    starts, bucket = starts[by_bucket], bucket[by_bucket]
    prefix = Prefix(data)
    order = suffix_sort(prefix, starts, bucket, size)
    sorted_ = starts[order]
    claimed = np.flatnonzero((bucket[1:] == bucket[:-1]) & (prefix.compare(sorted_[1:], sorted_[:-1], size) == 0)) + 1
    views = np.lib.stride_tricks.sliding_window_view(data, size) if len(data) >= size else None
    true = np.zeros(len(claimed), bool)
    for k in range(0, len(claimed), 1 << 14):
        pair = claimed[k : k + (1 << 14)]
        true[k : k + (1 << 14)] = (views[sorted_[pair]] == views[sorted_[pair - 1]]).all(1)
    opens = np.ones(len(starts), bool)
    opens[claimed[true]] = False
    number = np.empty(len(starts), np.int64)
    number[order] = np.cumsum(opens)
    if not true.all():
        bad = np.isin(bucket, bucket[claimed[~true]])
        known: dict[tuple[int, bytes], int] = {}
        for k in np.flatnonzero(bad):
            text = data[starts[k] : starts[k] + size].tobytes()
            number[k] = known.setdefault((int(bucket[k]), text), len(starts) + 1 + len(known))
    out = np.empty(len(starts), np.int64)
    out[by_bucket] = number
    return out


def seen_earlier(bodies: list[bytes], anchor: np.ndarray, lead: np.ndarray, owner: np.ndarray, within: bool, size: int):
    """Runs of strings that also occur with a smaller owner, as strip, first string in it and number of strings.

    A strip holds consecutive strings of ``size`` bytes; ``lead`` is the place of its anchor, ``anchor`` a number that equal
    anchors share. The owner of a string is its strip's, or that plus its place in the strip (``within``).
    """
    sizes = np.array([len(b) for b in bodies], np.int64)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    n = sizes - size + 1
    strip = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(strip)) - np.repeat(np.cumsum(n) - n, n)
    starts = (np.cumsum(sizes) - sizes)[strip] + place
    number = equal_strings(data, starts, anchor[strip] * (size + 1) + lead[strip] - place, size)
    _, number = np.unique(number, return_inverse=True)
    own = owner[strip] + (place if within else 0)
    least = np.full(number.max() + 1 if len(number) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, number, own)
    at = np.flatnonzero(least[number] < own)
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (strip[at[1:]] != strip[at[:-1]])
    first = np.flatnonzero(opens)
    return strip[at[first]], place[at[first]], np.diff(np.append(first, len(at)))


class Texts:
    """The bytes of a column of texts (null: empty), and their strips."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        self.n = len(column)
        self.bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        body = column.buffers()[2]
        self.data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)

    def strips(self, size: int, gram: int):
        """``row, at, n, lead, h, s`` of groups of whole texts: row in the column, first byte in ``data``, number of strings,
        place of the anchor in the strip, hashes of the anchor and of the whole strip."""
        low = 0
        while low < self.n:
            high = max(low + 1, int(np.searchsorted(self.bounds, self.bounds[low] + PIECE, "right")) - 1)
            edges = self.bounds[low : high + 1]
            first, stop = int(edges[0]), int(edges[-1])
            parts = [_scan(self.data[a : min(stop, a + PIECE + size - 1)], edges - a, PIECE, size, gram, a) for a in range(first, max(stop - size + 1, first + 1), PIECE)]
            row, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield (row + low, *rest)
            low = high

    def body(self, at: int, n: int, size: int) -> bytes:
        return self.data[at : at + n + size - 1].tobytes()


def _scan(body: np.ndarray, edges: np.ndarray, own: int, size: int, gram: int, offset: int):
    """Strips of the strings that start in the first ``own`` bytes. Texts lie between ``edges``, which may reach beyond."""
    strings = min(len(body) - size + 1, own + (len(edges) > 2) * len(body))
    if strings <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    power, inverse = _powers(_room(len(body) + 1))
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power[: len(body)], out=sums[1:])
    grams = sums[gram:] - sums[:-gram]
    grams *= inverse[: len(grams)]
    grams ^= grams >> np.uint64(31)
    grams *= _SPREAD
    bits = np.uint64(len(body).bit_length())
    key = grams >> bits << bits
    key |= np.arange(len(key) - 1, -1, -1, dtype=np.uint64)  # of equal grams the last one
    least, width, wide = key, 1, size - gram + 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: width - wide], least[wide - width :])
    least = least[:strings]
    edges = np.clip(edges, 0, len(body))
    opens = np.append(np.flatnonzero(least[1:] != least[:-1]) + 1, edges[:-1][edges[:-1] < strings])
    start = np.unique(opens)
    row = np.searchsorted(edges, start, "right") - 1
    stop = np.minimum(np.append(start[1:], strings), edges[row + 1] - size + 1)
    kept = stop > start
    start, stop, row = start[kept], stop[kept], row[kept]
    anchor = len(key) - 1 - (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    whole = mix((sums[stop + size - 1] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
    return row, start + offset, stop - start, anchor - start, mix(grams[anchor]), whole


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Which items are the first with their keys."""
    mixed = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        mixed = mix(mixed + key.astype(np.uint64))
    out = np.zeros(len(mixed), bool)
    out[np.unique(mixed, return_index=True)[1]] = True
    return out


def _columns(names, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a) for a in arrays], names)


def repeated_anchors(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """``h`` of anchors in several texts. Tasks send the number of texts they have met an anchor in, cut at two."""

    def emit(batches):
        held, n = [], 0

        def counts():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return _columns(["h", "c"], h, np.minimum(c, 2).astype(np.int32))

        for batch in batches:
            for row, _, _, _, h, _ in Texts(batch.column("text")).strips(size, gram):
                held.append(h[_firsts(row, h)])
                n += len(held[-1])
                if n >= 2 * HELD:
                    yield counts()
                    held, n = [], 0
        if n:
            yield counts()

    met = docs.select("text").mapInArrow(emit, "h long, c int")
    return met.groupBy("h").agg(F.sum("c").alias("c")).filter("c > 1").select("h")


def suspects(docs: DataFrame, again, size: int, gram: int) -> DataFrame:
    """``h, s, doc, t, at, n, sure``: strips that may hold strings seen earlier; ``at`` counts from the text's first byte.

    ``sure`` strips are settled: the task has met their strings earlier, in the text or in a document with a smaller id.
    Of the others a task sends one for each kind (``h, s``), that of the smallest id.
    """
    names = ["h", "s", "doc", "t", "at", "n", "sure"]

    def settled(h, s, doc, t, at, n, sure):
        order = np.lexsort((at, doc, s, h, sure))
        head = np.ones(len(order), bool)
        head[1:] = (h[order][1:] != h[order][:-1]) | (s[order][1:] != s[order][:-1]) | sure[order][1:]
        least = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        sure[order] |= doc[order] > least
        # keys of settled strips only spread them evenly
        spread = mix(mix(doc.astype(np.uint64)) + at.astype(np.uint64))
        return _columns(names, np.where(sure, spread, h), np.where(sure, np.uint64(0), s), doc, t, at.astype(np.int32), n.astype(np.int32), sure)

    def emit(batches):
        held, count = [], 0
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy() for c in ("doc_id", "t"))
            texts = Texts(batch.column("text"))
            for row, at, n, lead, h, s in texts.strips(size, gram):
                first = _firsts(row, h, s)
                local = at - texts.bounds[row]
                new = np.flatnonzero(first)
                several = ~_firsts(row[new], h[new])
                kinds = mix(h + mix(row.astype(np.uint64)))
                mixed = new[np.isin(kinds[new], kinds[new][several])]  # anchors of a text under which its strips differ
                mixed = mixed[np.lexsort((at[mixed], h[mixed], row[mixed]))]
                for part in _slices(kinds[mixed], n[mixed] + size - 1):
                    own = mixed[part]
                    _, anchor = np.unique(kinds[own], return_inverse=True)
                    bodies = [texts.body(a, b, size) for a, b in zip(at[own], n[own], strict=True)]
                    strip, place, runs = seen_earlier(bodies, anchor, lead[own], at[own], True, size)
                    if len(strip):
                        k = own[strip]
                        z = np.zeros(len(k), np.uint64)
                        held.append((z, z, ids[row[k]], marks[row[k]], local[k] + place, runs, np.ones(len(k), bool)))
                kept = ~first | may_hold(again, h)
                r = row[kept]
                held.append((h[kept], s[kept], ids[r], marks[r], local[kept], n[kept], ~first[kept]))
                count += kept.sum()
                if count >= HELD:
                    yield settled(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, count = [], 0
        if held:
            yield settled(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return docs.select("doc_id", "t", "text").mapInArrow(emit, "h long, s long, doc long, t int, at int, n int, sure boolean")


def _slices(keys: np.ndarray, weights: np.ndarray):
    """Slices of whole groups of equal neighbouring keys, of about SORTED in weight."""
    if not len(keys):
        return
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    before = np.concatenate([[0], np.cumsum(weights)])[np.append(heads, len(keys))]
    heads, k = np.append(heads, len(keys)), 0
    while k < len(heads) - 1:
        to = max(k + 1, int(np.searchsorted(before, before[k] + SORTED, "right")) - 1)
        yield slice(int(heads[k]), int(heads[to]))
        k = to


def _strip_key(h: np.ndarray, s: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(mix(h + mix(s)) + doc.astype(np.uint64))


def _bodies(docs: DataFrame, picked, many, size: int, gram: int) -> DataFrame:
    """Bytes of the strips whose key ``picked`` may hold, but not those of anchors that ``many`` may hold."""

    def emit(batches):
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy() for c in ("doc_id", "t"))
            texts = Texts(batch.column("text"))
            for row, at, n, lead, h, s in texts.strips(size, gram):
                ok = may_hold(picked, _strip_key(h, s, ids[row]))
                if many is not None:
                    ok &= ~may_hold(many, h)
                k = np.flatnonzero(ok & _firsts(row, h, s))
                if len(k):
                    body = pa.array([texts.body(a, b, size) for a, b in zip(at[k], n[k], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h[k].view(np.int64)), pa.array(ids[row[k]]), pa.array(marks[row[k]]), pa.array((at - texts.bounds[row])[k].astype(np.int32)),
                        pa.array(lead[k].astype(np.int32)), body], ["h", "doc", "t", "at", "lead", "body"])

    return docs.select("doc_id", "t", "text").mapInArrow(emit, "h long, doc long, t int, at int, lead int, body binary")


def _strings(docs: DataFrame, picked, many, size: int, gram: int) -> DataFrame:
    """Strings one by one, by 128 bits of hash, of strips whose key ``picked`` and whose anchor ``many`` may hold."""

    def emit(batches):
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy() for c in ("doc_id", "t"))
            texts = Texts(batch.column("text"))
            for row, at, n, lead, h, s in texts.strips(size, gram):
                k = np.flatnonzero(may_hold(many, h) & may_hold(picked, _strip_key(h, s, ids[row])) & _firsts(row, h, s))
                for part in _slices(np.arange(len(k)), n[k] + size - 1):
                    own = k[part]
                    sizes = n[own] + size - 1
                    data = np.frombuffer(b"".join(texts.body(a, b, size) for a, b in zip(at[own], n[own], strict=True)), np.uint8)
                    strip = np.repeat(own, n[own])
                    place = np.arange(len(strip)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                    start = np.repeat(np.cumsum(sizes) - sizes, n[own]) + place
                    a, b = mix(Prefix(data).hash(start, size)), mix(Prefix(255 - data).hash(start, size) + h[strip])
                    r = row[strip]
                    yield _columns(["a", "b", "doc", "t", "at"], a, b, ids[r], marks[r], (at[strip] - texts.bounds[r] + place).astype(np.int32))

    return docs.select("doc_id", "t", "text").mapInArrow(emit, "a long, b long, doc long, t int, at int")


def _sort_buckets(size: int):
    """Task: strips sorted by anchor come in, runs of strings seen in a smaller document go out."""

    def emit(batches):
        held, weight = [], 0

        def found(table: pa.Table):
            h = table["h"].to_numpy()
            _, anchor = np.unique(h, return_inverse=True)
            doc, at = table["doc"].to_numpy(), table["at"].to_numpy()
            strip, place, runs = seen_earlier(table["body"].to_pylist(), anchor, table["lead"].to_numpy().astype(np.int64), doc, False, size)
            return _columns(["doc", "t", "at", "n"], doc[strip], table["t"].to_numpy()[strip], (at[strip] + place).astype(np.int32), runs.astype(np.int32))

        for batch in batches:
            held.append(batch)
            weight += batch.nbytes
            if weight >= SORTED:
                table = pa.Table.from_batches(held)
                h = table["h"].to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
                if cut:
                    for part in _slices(h[:cut], pc.binary_length(table["body"]).to_numpy()[:cut].astype(np.int64)):
                        yield found(table.slice(part.start, part.stop - part.start))
                held = table.slice(cut).to_batches()
                weight = sum(b.nbytes for b in held)
        if held:
            table = pa.Table.from_batches(held)
            for part in _slices(table["h"].to_numpy(), pc.binary_length(table["body"]).to_numpy().astype(np.int64)):
                yield found(table.slice(part.start, part.stop - part.start))

    return emit


def repeated_strings(docs: DataFrame, size: int = SIZE, gram: int = GRAM, kinds: int = KINDS) -> DataFrame:
    """``doc, t, at, n``: ``n`` strings from byte ``at`` on that also start earlier, in a document with a smaller id or in the
    same text. Runs may overlap. Rows need an id; ``t`` is a hash of the text that tells rows with one id apart.

    1. Anchors in several texts: counted by Spark, kept as a bitmap. What it lets through in vain costs work only.
    2. Strips of these anchors, one of a kind from each task, get the smallest id of their kind. All but the first go.
    3. Firsts under an anchor with several kinds are sorted with each other, where the anchor has up to ``kinds`` kinds.
       Their strings travel one by one otherwise, so that no task holds a group of unbounded size.
    """
    again = bitmap(cut_lineage(repeated_anchors(docs, size, gram), "anchors"))
    least = F.min("doc").over(W.partitionBy("h", "s"))
    known = suspects(docs, again, size, gram).withColumn("first", F.col("doc") <= least).withColumn("first", F.col("first") & ~F.col("sure"))
    known = cut_lineage(known.drop("sure"), "strips")
    again.unpersist()
    firsts = known.filter("first").select("h", "s", "doc").distinct()
    anchors = cut_lineage(firsts.groupBy("h").agg(F.count_distinct("s").alias("kinds")).filter("kinds > 1"), "mixed")
    mixed = firsts.join(anchors, "h", "left_semi").select("h", "s", "doc")

    def keys(batches):
        for batch in batches:
            h, s, doc = (batch.column(c).to_numpy() for c in ("h", "s", "doc"))
            yield _columns(["key"], _strip_key(h.view(np.uint64), s.view(np.uint64), doc))

    picked = bitmap(cut_lineage(mixed.mapInArrow(keys, "key long"), "picked"))
    wide = anchors.filter(F.col("kinds") > kinds).select("h")
    many = None if wide.isEmpty() else bitmap(wide)
    out = known.filter("NOT first").select("doc", "t", "at", "n")
    sent = _bodies(docs, picked, many, size, gram)
    out = out.union(sent.repartition("h").sortWithinPartitions("h").mapInArrow(_sort_buckets(size), "doc long, t int, at int, n int"))
    if many is not None:
        strings = _strings(docs, picked, many, size, gram)
        first = strings.groupBy("a", "b").agg(F.min("doc").alias("least"))
        out = out.union(strings.join(first, ["a", "b"]).filter("least < doc").select("doc", "t", "at", F.lit(1).alias("n")))
    return out


def _kept(body: np.ndarray, at: np.ndarray, n: np.ndarray, size: int) -> tuple[bytes, int, int]:
    """What is left of a text, its removed bytes and the runs they form."""
    edges = np.zeros(len(body) + 1, np.int32)
    np.add.at(edges, at, 1)
    np.add.at(edges, np.minimum(at + n + size - 1, len(body)), -1)
    gone = np.cumsum(edges[:-1]) > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    return body[~gone].tobytes(), int(gone.sum()), int(opens.sum())


def dedup_bytes(docs: DataFrame, size: int = SIZE, gram: int = GRAM, kinds: int = KINDS) -> DataFrame:
    """``docs`` with ``kept`` (the bytes of ``text`` without those of strings of ``size`` bytes that start earlier too, in a
    smaller ``doc_id`` or in the same text), ``n_bytes``, ``n_removed`` and ``n_spans``, the runs of removed bytes; underscores
    are added to these names where taken. ``doc_id`` is a whole number.

    Every row stays, if with nothing kept. Bytes may be cut inside a character. A null text counts as empty; texts shorter
    than ``size`` lose nothing. Rows with one id do not affect each other; rows without an id neither lose bytes nor make
    others lose any. An empty table gives an empty table.
    """
    t, kept, n_bytes, n_removed, n_spans, may, runs = (free_name(docs, x) for x in ("text_mark", "kept", "n_bytes", "n_removed", "n_spans", "may_lose", "runs"))
    names = docs.columns
    known = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("t"), "text")
    found = cut_lineage(repeated_strings(known, size, gram, kinds), "repeated")
    touched = bitmap(cut_lineage(found.select("doc").distinct(), "touched"))
    marked_type = T.StructType([*docs.schema.fields, T.StructField(may, T.BooleanType())])
    text_at, id_at = names.index("text"), names.index("doc_id")

    def mark(batches):
        for batch in batches:
            ids = batch.column(id_at).cast(pa.int64())
            flag = may_hold(touched, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ~ids.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flag)], marked_type.names)

    marked = docs.mapInArrow(mark, marked_type)
    listed = found.groupBy("doc", "t").agg(F.collect_list(F.struct("at", "n")).alias("p"))  # of one text
    lost = listed.select(F.col("doc").alias("lost_doc"), F.col("t").alias("lost_mark"), F.col("p.at").alias("lost_at"), F.col("p.n").alias("lost_n"))
    hit = marked.filter(F.col(may)).withColumn(t, F.hash("text")).join(lost, (F.col("doc_id") == F.col("lost_doc")) & (F.col(t) == F.col("lost_mark")), "left")
    own = [F.col(f"`{c}`") for c in names]
    out = T.StructType([*docs.schema.fields, T.StructField(kept, T.BinaryType()), *(T.StructField(c, T.LongType()) for c in (n_bytes, n_removed, n_spans))])

    def cut(batches):
        for batch in batches:
            texts = Texts(batch.column(text_at))
            at, n = batch.column(len(names)), batch.column(len(names) + 1)
            found = []
            for k in range(texts.n):
                body = texts.data[texts.bounds[k] : texts.bounds[k + 1]]
                if at[k].is_valid and len(at[k].values):
                    rest, removed, spans = _kept(body, at[k].values.to_numpy(), n[k].values.to_numpy(), size)
                else:
                    rest, removed, spans = body.tobytes(), 0, 0
                found.append((rest, len(body), removed, spans))
            columns = [pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], out.names)

    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    calm = marked.filter(~F.col(may)).select(*own, whole.alias(kept), F.octet_length(whole).cast("long").alias(n_bytes), F.lit(0).cast("long").alias(n_removed), F.lit(0).cast("long").alias(n_spans))
    return hit.select(*own, "lost_at", "lost_n").mapInArrow(cut, out).unionByName(calm)


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    cut = dedup_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
