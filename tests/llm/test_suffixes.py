"""Suffix-array dedup against a plain version, and its sort against Python's."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import suffixes

SMALL = "/root/testdata/sf0.001"


def plain(rows, size):
    """Of (id, text) rows: id, bytes, removed, runs, digest of what is left."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in texts:
        if i is not None:
            for k in range(len(b) - size + 1):
                key = b[k:k + size]
                if key not in least or i < least[key]:
                    least[key] = i
    out = Counter()
    for i, b in texts:
        gone, seen = np.zeros(len(b), bool), set()
        if i is not None:
            for k in range(len(b) - size + 1):
                key = b[k:k + size]
                if least[key] < i or key in seen:
                    gone[k:k + size] = True
                seen.add(key)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out[i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(df, names=("n_bytes", "n_removed", "n_spans", "kept")):
    *counts, kept = names
    return Counter(tuple(r) for r in df.select("doc_id", *counts, F.sha2(kept, 256)).collect())


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = suffixes.op12_suffix_dedup(spark, SMALL)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, 100)


def edited(rng, text):
    """A near copy."""
    words = text.split()
    for _ in range(rng.randrange(4)):
        words[rng.randrange(len(words))] = "edit"
    return " ".join(words)


@pytest.mark.parametrize("kinds", [1 << 12, 2])
def test_near_copies(docs_of, kinds):
    """Copies, near copies, shared passages and repeats within a text; also with nearly all anchors over the bound."""
    rng = random.Random(kinds)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(12)]
    passage = " ".join(f"p{rng.randrange(90)}" for _ in range(30))
    rows = [(k, edited(rng, rng.choice(base))) for k in range(60)]
    rows += [(100 + k, f"{rng.random()} {passage} {rng.random()} " + passage[k % 9:] + f" {rng.random()}") for k in range(40)]
    rows += [(200, "ab" * 300), (201, "xab" * 200), (202, "#" * 500), (203, "é" * 200 + "#" * 130), (204, base[0] + base[0])]
    rng.shuffle(rows)
    assert found(suffixes.dedup_bytes(docs_of(rows), 30, 12, kinds)) == plain(rows, 30)


def test_odd_rows(docs_of, odd_rows):
    df = docs_of(odd_rows, clashing=True).withColumn("Kept", F.lit(1)).withColumn("n_spans", F.lit(2))
    got = suffixes.dedup_bytes(df, 40, 15)
    assert got.columns[:len(df.columns)] == df.columns
    assert found(got, ("n_bytes", "n_removed_", "n_spans_", "kept_")) == plain([r[:2] for r in odd_rows], 40)
    assert suffixes.dedup_bytes(df.filter("doc_id > 99"), 40, 15).count() == 0


def test_long_text_in_pieces(docs_of):
    """A text over several pieces, with repeats across their edges."""
    rng = random.Random(1)
    part = " ".join(str(rng.randrange(10**6)) for _ in range(90_000))
    assert len(part) > suffixes.PIECE
    tail = part[suffixes.PIECE - 300:suffixes.PIECE + 300]
    rows = [(1, part), (2, "start " + tail + " end"), (3, part[:700] + "!" + part[100:900])]
    assert found(suffixes.dedup_bytes(docs_of(rows), 100, 40)) == plain(rows, 100)


def test_sort_and_collisions(monkeypatch):
    rng = random.Random(4)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(3_000)).encode(), np.uint8)
    starts = np.array(rng.sample(range(2_900), 900))
    bucket = np.sort(np.array([rng.randrange(7) for _ in range(900)]))
    order = suffixes.suffix_sort(suffixes.Prefix(data), starts, bucket, 20)
    text = data.tobytes()
    assert list(order) == sorted(range(900), key=lambda k: (bucket[k], text[starts[k]:starts[k] + 20]))

    def classes(number):
        return len({(n, b, text[s:s + 8]) for n, b, s in zip(number, bucket, starts)}), len(set(number))

    true = len({(b, text[s:s + 8]) for b, s in zip(bucket, starts)})
    assert classes(suffixes.equal_strings(data, starts, bucket, 8)) == (true, true)
    monkeypatch.setattr(suffixes, "_BASE", 1)  # hashes are sums: all anagrams collide
    suffixes._powers.cache_clear()
    assert classes(suffixes.equal_strings(data, starts, bucket, 8)) == (true, true)
    suffixes._powers.cache_clear()
