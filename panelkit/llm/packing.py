"""Best-fit packing of tokenized documents by exact complements."""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.session import cut_lineage

from .columns import read
from .workers import give_back, short_batches, tidy

#: Tokens of a sequence.
SIZE = 2048
#: Id put after each document.
END = 0
#: Slices in which pieces of one length are numbered, each in a task of its own.
SLICES = 1024
#: Words whose ids a worker remembers since it last forgot; it holds as many older ones again.
REMEMBERED = 1 << 18


class WordIds:
    """Ids of words as little-endian 32-bit numbers.

    The vocabulary drops white space and never looks across it, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids at the end of a piece
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, text: bytes) -> bytes:
        # The vocabulary composes first and lower-cases last, and a capital and its small letter compose with other marks: only
        # words of ASCII alone may be lowered before it. Its special strings are told apart by case.
        # bytes.split() cuts at ASCII white space alone.
        if b"<|" in text:
            words = text.split()
        elif text.isascii():
            words = text.lower().split()
        else:
            words = [w.lower() if w.isascii() else w for w in text.split()]
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            fresh = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + 2 * len(fresh) > REMEMBERED:  # words not met since the last time are dropped
            self.older, self.known = known, {}
            known, fresh = self.known, list(dict.fromkeys(words))
        self._learn(self._recalled(fresh))
        return b"".join(map(known.__getitem__, words))

    def _recalled(self, words: Iterable[bytes]) -> list[bytes]:
        """Takes words over from the older ones; returns those that are not there."""
        known, older = self.known, self.older
        known.update((w, older[w]) for w in words if w in older)
        return [w for w in words if w not in known]

    def _learn(self, fresh: list[bytes]) -> None:
        """A mark after an ASCII letter or digit is a piece of its own, so only the word before it has to be known."""
        known = self.known
        cores = {w: w[:-1] for w in fresh if w[-1] in b".,!;:?" and w[-2:-1].isalnum()}
        wanted = dict.fromkeys([*(cores.get(w, w) for w in fresh), *(w[-1:] for w in cores)])
        joined, others, merge = [], [], self.tokenizer.model.tokenize
        for w in self._recalled(wanted):
            if w.isalpha():  # ASCII letters in lower case go through the merges as they are
                ids = [token.id for token in merge(w.decode("ascii").lower())]
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                (joined if _one_piece(w) else others).append(w)
        if joined:
            found = self.tokenizer.encode_batch_fast([b" ".join(joined).decode("utf-8")], add_special_tokens=False)
            ids = np.array(found[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            packed, starts = ids.tobytes(), [0, *ends.tolist()]
            known.update((w, packed[a:b]) for w, a, b in zip(joined, starts[:-1], starts[1:], strict=True))
        if others:
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in others], add_special_tokens=False)
            known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(others, found, strict=True))
        known.update((w, known[core] + known[w[-1:]]) for w, core in cores.items())


def _one_piece(word: bytes) -> bool:
    """Whether a word is letters alone, composed and in lower case too: one piece, whose last id closes a word."""
    text = word.decode("utf-8")
    return text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def forget() -> None:
    word_ids.cache_clear()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, piece, start, length, ids_crc32``: a document's ids and the end id, cut at
    every ``size``. A null or empty text is the end id alone."""
    path = path or default_path()
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    end = np.array([END], "<u4").tobytes()

    def cut(batches):
        give_back()  # what tasks before left; words stay for the next task
        words = word_ids(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text").cast(pa.large_binary())):
                ids = words.ids(text.as_py() or b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class Plan:
    """Which lengths share a sequence: patterns of lengths and how often each is used.

    Works on the count of each length alone, ``size`` numbers whatever the table's rows.
    """

    def __init__(self, counts: dict[int, int], size: int = SIZE):
        self.size, self.patterns = size, []
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self._take((size,))
        self._exact()
        self._best_fit()

    def _take(self, lengths: tuple[int, ...]) -> bool:
        """Use a pattern as often as lengths are left for it."""
        times = min(int(self.left[x]) // lengths.count(x) for x in lengths)
        if times:
            for x in lengths:
                self.left[x] -= times
            self.patterns.append((lengths, times))
        return times > 0

    def _pairs(self, total: int) -> np.ndarray:
        """Larger parts a of all pairs a + b = total with both lengths left, largest first."""
        if total < 2:
            return np.zeros(0, np.int64)
        held = self.left[: total + 1] > 0
        a = np.arange(total - 1, (total + 1) // 2 - 1, -1)
        return a[held[a] & held[total - a]]

    def _exact(self) -> None:
        """Fill the gap beside each length, longest first, by one, two or three lengths that sum to it."""
        for length in range(self.size - 1, 0, -1):
            gap = self.size - length
            if not self.left[length] or gap > 3 * length:
                continue
            if gap <= length:
                self._take((length, gap))
            for a in self._pairs(gap):
                if not self.left[length]:
                    break
                self._take((length, int(a), gap - int(a)))
            for a in range(min(length, gap - 2), (gap + 2) // 3 - 1, -1):
                if not self.left[length]:
                    break
                if self.left[a]:
                    for b in self._pairs(gap - a):
                        if not self.left[a] or not self.left[length]:
                            break
                        if b <= a:
                            self._take((length, a, int(b), gap - a - int(b)))

    def _best_fit(self) -> None:
        """What is left: the longest length, then always the longest that fits."""
        for length in range(self.size - 1, 0, -1):
            while self.left[length]:
                chosen, gap = [length], self.size - length
                left = self.left.copy()
                left[length] -= 1
                while gap:
                    fits = np.flatnonzero(left[1 : gap + 1])
                    if not len(fits):
                        break
                    best = int(fits[-1]) + 1
                    chosen.append(best)
                    left[best] -= 1
                    gap -= best
                self._take(tuple(chosen))

    def places(self) -> tuple[np.ndarray, ...]:
        """Sorted by key: length * 2**44 + first number of the length, first sequence, place in the sequence."""
        used, rows, sequence = np.zeros(self.size + 1, np.int64), [], 0
        for lengths, times in self.patterns:
            offset = 0
            for x in lengths:
                rows.append(((x << 44) + int(used[x]), sequence, offset))
                used[x] += times
                offset += x
            sequence += times
        rows.sort()
        return tuple(np.array(column, np.int64) for column in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.patterns)


def numbered(cut: DataFrame) -> DataFrame:
    """``number`` of each piece among those of its length, from 0: numbers within slices, plus the slices before."""
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)))
    totals = cut.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("length", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("inside", F.row_number().over(inside) - 1)
    return ranked.join(totals, ["length", "slice"]).withColumn("number", F.col("before") + F.col("inside")).drop("before", "inside", "slice")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Pack all documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row for each piece.

    The driver sees only how many pieces each length has; it plans patterns, and pieces find their places by
    length and number. Repeated rows are packed each for itself. No documents: no rows.
    """
    short_batches(docs.sparkSession)
    cut = cut_lineage(pieces(docs, path, size), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Plan(counts, size).places())
    ready = numbered(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    schema = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    names = cut.columns

    @tidy
    def place(batches):
        key, sequence, offset = places.value
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column("number").to_numpy()
            own = (batch.column("length").to_numpy() << 44) + number
            at = np.searchsorted(key, own, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence[at] + own - key[at]), pa.array(offset[at])], schema.names,
            )

    return ready.mapInArrow(place, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
