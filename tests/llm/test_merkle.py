"""The Merkle manifest against a plain tree, and the layout against its definition."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelkit.llm import merkle

SMALL = "/root/testdata/sf0.001"
FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([h("".join(row[k:k + 8])) for k in range(0, len(row), 8)])
    return levels


def plain_steps(levels, k):
    out = []
    for row in levels[:-1]:
        low = k - k % 8
        out.append(("".join(row[low:k]), "".join(row[k + 1:low + 8])))
        k //= 8
    return out


def plain(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in langs:
        members = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        built[lang] = members, plain_levels([plain_leaf(r) for r in members])
    top = plain_levels([built[lang][1][-1][0] for lang in langs])
    out = Counter()
    for at, lang in enumerate(langs):
        members, levels = built[lang]
        for k, row in enumerate(members):
            steps = plain_steps(levels, k) + plain_steps(top, at)
            altered = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                altered = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            node = plain_leaf(altered)
            for before, after in steps:
                node = h(before + node + after)
            root = top[-1][0]
            out[row[0], levels[0][k], levels[-1][0], root, h("".join(a + b for a, b in steps)), node, node == root] += 1
    return out


def found(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in df.select(*names).collect())


def test_layout():
    for levels in range(1, 6):
        place = merkle.layout(levels)
        assert sorted(np.concatenate(place)) == list(range(merkle.nodes_of(levels)))
    three = merkle.layout(3)
    assert [list(x[:3]) for x in three] == [[0], [1, 10, 19], [2, 3, 4]]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 73, 511])
def test_blocks(n):
    """Entries of a block that ends its tree, and of one that does not."""
    entries = [h(str(k)) for k in range(n)]
    levels = merkle.levels_for(n)
    nodes = merkle.build_nodes(entries, levels)
    assert nodes[:32].hex() == plain_levels(entries)[-1][0]
    for k, steps in enumerate(merkle.steps_of(nodes, n, levels)):
        assert merkle.fold(entries[k], steps) == nodes[:32].hex()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = found(merkle.op13_merkle_manifest(spark, SMALL))
    assert got == plain(rows)
    assert 0 < sum(not k[-1] for k in got) < len(rows)


def test_several_levels_of_blocks(spark):
    """Blocks of 64 entries give three levels of blocks for a group of 5,000 rows, and one for a group of one row."""
    rows = [(i, "s", "en" if i else None, i, f"Text {i}") for i in range(5_000)]
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    assert found(merkle.proofs(df, merkle.every_third(), size=64)) == plain(rows)
    assert len(merkle.manifest(df, size=64)[0].levels) == 3


def test_odd_rows(spark, odd_rows):
    rows = [(i, s, [None, "en", "é", "-", ""][k % 5], None if t is None else len(t), t) for k, (i, t, s) in enumerate(odd_rows)]
    df = spark.createDataFrame([(*r, 1, "x", 3) for r in rows], FIELDS + ", Tree int, at string, digest int")
    assert found(merkle.proofs(df, merkle.every_third())) == plain(rows)
    assert merkle.proofs(df.filter("doc_id > 1000"), merkle.every_third()).count() == 0
