"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import heapq
import json
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import read

#: Fixed value: how the byte-level vocabulary cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points up to here are letters and digits alike for the pattern and for the library; texts with others are cut by the library.
STABLE = 0x52F
#: Pieces of text whose counts a worker remembers.
REMEMBERED = 1_000_000
#: Tokens above which a text is over the limit.
LIMIT = 1024


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merger:
    """The merges of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        self.rank = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.byte = [vocabulary[letter] for letter in byte_letters()]
        special = [regex.escape(x["content"]) for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.pieces = regex.compile(PATTERN)
        self.beyond = regex.compile(f"[^\\x00-{chr(STABLE)}]")
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.letter = {letter: b for b, letter in enumerate(byte_letters())}
        self.known: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Symbols left of one piece: its bytes less its merges.

        The heap holds adjacent pairs by rank, then place. Symbols are a doubly linked list; a popped pair whose
        symbols have changed since is stale and skipped.
        """
        symbol = [self.byte[b] for b in piece.encode("utf-8")]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = []
        for i in range(n - 1):
            found = rank.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = made, -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                found = rank.get((made, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, made, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = rank.get((symbol[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, symbol[h], made, found[1]))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a text. Strings of special tokens are one token each, wherever they stand."""
        special = len(self.special.findall(text)) if self.special else 0
        parts = self.special.split(text) if special else (text,)
        return special + sum(self._plain(part) for part in parts)

    def pieces_of(self, text: str) -> list[str]:
        """Pieces that merges stay within."""
        if text.isascii() or not self.beyond.search(text):
            return self.pieces.findall(text)
        return [bytes(map(self.letter.__getitem__, piece)).decode() for piece, _ in self.cut(text)]

    def _plain(self, text: str) -> int:
        known, total = self.known, 0
        for piece in self.pieces_of(text):
            n = known.get(piece)
            if n is None:
                n = self.merged(piece)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[piece] = n
            total += n
        return total


@cache
def merger(path: str) -> Merger:
    """One for each worker and file."""
    return Merger(path)


def forget() -> None:
    merger.cache_clear()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, n_bytes, n_tokens, over_limit``, one row for each row.

    ``path`` names a byte-level BPE vocabulary that every executor can open. Null and empty texts have no bytes
    and no tokens. Nothing is shuffled; long texts are one task's work, piece by piece.
    """
    path = path or default_path()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def counts(batches):
        own = merger(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            n = [own.count(x.as_py()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = docs.select("doc_id", "text").mapInArrow(counts, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
