"""Cases that once gave wrong results: code points the library cuts its own way, rows of one id, missing labels, taken names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelkit.llm import mixing, token_counts, toxicity


@pytest.fixture(scope="module")
def counter():
    path = token_counts.default_path()
    return token_counts.merger(path), Tokenizer.from_file(path)


def test_every_code_point_is_cut_as_the_library_does(counter):
    own, library = counter
    for low in range(0, 0x110000, 0x4000):
        points = [c for c in range(low, low + 0x4000) if not 0xD800 <= c < 0xE000]
        texts = [f"{chr(c)}'s 1{chr(c)}2 a{chr(c)}b" for c in points]
        if low >= 0x24000:  # unassigned and private planes: a few of each
            texts = texts[::97]
        wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [own.count(t) for t in texts] == wanted


def test_mix_has_a_row_for_each_row(docs_of):
    rows = [(1, "a b c d", "s1"), (1, "a b c d", "s1"), (1, "x y", "s2"), (None, "u v", "s1"), (None, "u v w", "s2"), (2, None, "s2"), (3, "k " * 9, None)]
    got = mixing.taken_words(docs_of(rows)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    assert Counter(r["source_size"] for r in got) == Counter(sizes[r[2]] for r in rows)
    again = mixing.taken_words(docs_of(rows).repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


@pytest.mark.parametrize("toxic", [[], [1, 1, 1], [0, 0], [None]])
def test_without_labels_of_both_classes_all_documents_stay(spark, docs_of, toxic):
    docs = docs_of([(k, f"some words of text {k}") for k in range(20)])
    labels = spark.createDataFrame([(k + 1, 1, t) for k, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs, labels).count() == 20


def test_tag_leaves_columns_of_its_names_alone(spark, docs_of):
    docs = docs_of([(k, "nice words" if k % 2 else "vile words") for k in range(40)]).withColumn("Spans", F.lit(7)).withColumn("score", F.lit(1.5))
    labels = spark.createDataFrame([(k, 1, 1 - k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    out = toxicity.tag(docs, toxicity.fit_tagger(docs, labels))
    assert out.columns[-2:] == ["score_", "spans_"]
    assert {r["score"] for r in out.collect()} == {1.5}
