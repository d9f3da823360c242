"""Helpers of the document tests; the session is that of the folder above."""

import random

import pytest

FRAME = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash, in another case too, with names the operators use.
CLASHING = "size int, Key string, slice int, pass int, n_words int, N_removed int, toxicity int, mix_row int, place int, token int, score double"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) or (id, text, source) rows, with clashing columns on request."""

    def make(rows, clashing=False, parts=3):
        whole = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        if clashing:
            whole = [(*r, 1, "k", 2, 3, 4, 5, 6, 7, 8, 9, 0.5) for r in whole]
        return spark.createDataFrame(whole, FRAME + (", " + CLASHING if clashing else "")).repartition(parts)

    return make


def words(rng, n, size=60):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, repeated rows, one id with two texts, one very long text, marks and other scripts."""
    rng = random.Random(3)
    long = " ".join(words(rng, 30_000, 5_000))
    base = " ".join(words(rng, 120))
    return [
        (1, base, "a"), (1, base, "a"), (2, base, "a"), (3, None, "a"), (None, base, "b"), (None, None, None), (4, "", "b"), (5, " \n\t ", "b"),
        (6, long, "b"), (7, "x", None), (8, "Ünïcode ßtraße 中文字 \U0001f600 é", "c"), (9, base + " tail", "c"), (9, "other text of id nine", "c"),
        (10, "#" * 5_000, "c"), (11, "a b c", "c"), (12, "a\nb\nc\na\n", "c"),
    ]
