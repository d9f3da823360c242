"""Collocations against a plain count of all runs."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from panelkit.llm import collocations

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def pieces(text):
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
        yield re.findall("[^ \t]+", piece)


def plain_counts(texts):
    f, n = Counter(), 0
    for text in texts:
        for w in pieces(text):
            n += len(w)
            for size in range(1, 5):
                f.update(tuple(w[k:k + size]) for k in range(len(w) - size + 1))
    return f, n


def plain(rows, least, share, top):
    groups = defaultdict(list)
    for lang, text in rows:
        groups["und" if lang is None else lang].append(text)
    out = set()
    for lang, texts in groups.items():
        f, n = plain_counts(texts)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    if 100 * a >= share * found[p[k:k + size]]:
                        gone.add(p[k:k + size])
        ranked = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], score))
        for rank, (_, _, phrase, a, l, r, score) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, rank, phrase.decode(), a, l, r, n, score))
    return out


def found(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_query(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = collocations.op11_collocations(spark, SMALL)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint")
    assert found(got) == plain(rows, 30, 80, 2000)
    assert found(collocations.collocations(spark.read.parquet(f"{SMALL}/documents.parquet"), 4, 70, 300)) == plain(rows, 4, 70, 300)


def graph_rows():
    rng = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [("en", f"{rng.choice('abc')} {passage} {rng.choice('abc')}") for _ in range(9)]
    rows += [("en", "a b c a b c a b c a b c. A B c"), ("de", passage), ("en", "x x x x x x x, x x"), (None, "b a b a b a"), ("und", "b a")]
    rows += [(rng.choice(["en", "de"]), " ".join(rng.choice("abcdefg") + rng.choice(["", "", ",", "\n"]) for _ in range(60))) for _ in range(20)]
    return rows


def test_small_graphs(spark):
    """Circles, runs of one word, long unary paths, phrases in several languages, missing languages."""
    rows = graph_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, F int, words int").repartition(4)
    for least in (2, 5):
        assert found(collocations.collocations(df, least, 80, 50)) == plain(rows, least, 80, 50)


def test_flow_and_paths(spark):
    """All counts follow from edges; the long passage is one path, and its inner nodes are stored nowhere else."""
    rows = graph_rows()
    graph = collocations.word_graph(spark.createDataFrame(rows, "lang string, text string"), 3)
    names = {r["id"]: (r["lang"], r["word"]) for r in graph.vocabulary.collect()}
    got = Counter()
    for r in graph.phrases().collect():
        words = [names[w] for w in r["words"]]
        assert len({lang for lang, _ in words}) == 1
        got[words[0][0], tuple(w for _, w in words)] += r["f"]
    want = {}
    for lang in ("en", "de", "und"):
        f, _ = plain_counts([t for x, t in rows if (x or "und") == lang])
        want |= {(lang, p): n for p, n in f.items() if n >= 3}
    assert got == want
    longest = max(graph.paths.collect(), key=lambda r: len(r["words"]))
    assert [names[w][1] for w in longest["words"]] == [f"p{k}" for k in range(40)] and longest["f"] == 9


def test_odd_rows(docs_of, odd_rows):
    df = docs_of(odd_rows, clashing=True)
    assert found(collocations.collocations(df, 2, 80, 400)) == plain([("en", r[1]) for r in odd_rows], 2, 80, 400)
    assert collocations.collocations(df.filter("doc_id > 99")).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    """Pieces of texts give the words and breaks of the whole."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "Bé", "cc", " ", " ", "\t", ".", ", ", "dddddddddddddddddd"]) for _ in range(400)) for _ in range(20)] + ["x" * 300, "", ". a", None]
    whole = [(list(r), list(h), list(l)) for r, h, l in collocations.read_runs(pa.array(texts))]
    monkeypatch.setattr(collocations, "PIECE", 37)
    rows, hashes, last = [], [], []
    for r, h, l in collocations.read_runs(pa.array(texts)):
        rows += list(r)
        hashes += list(h)
        last += list(l)
    assert [(rows, hashes, last)] == whole
