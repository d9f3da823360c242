"""Contract queries against plain versions, on the smallest data and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import columns, fingerprints, jaccard, mixing, packing, quality_rules, revisits, substrings, token_counts, toxicity
from panelkit.llm.queries import all_oracles, all_queries

SMALL = "/root/testdata/sf0.001"


def split(text):
    return re.findall(columns.WORD, text or "")


@pytest.fixture(scope="module")
def small(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.collect()]


def plain_substrings(rows, size):
    """Kept words and counts for each (id, text)."""
    least = {}
    for i, text in rows:
        w = split(text)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k:k + size])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, text in rows:
        w, gone = split(text), set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def digest(df):
    kept = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(columns.WORD), F.lit(0)), " ")
    return Counter(tuple(r) for r in df.select("doc_id", df.columns[-2], df.columns[-1], F.sha2(kept, 256)).collect())


@pytest.mark.parametrize("log_cells", [8, 22])
def test_substrings(small, log_cells):
    """With a sketch so small that it rules nothing out, and with a large one."""
    df, rows = small
    got = digest(substrings.dedup_substrings(df, 20, 2, log_cells))
    assert got == plain_substrings(rows, 20)


def test_substrings_odd_rows(docs_of, odd_rows):
    df = substrings.dedup_substrings(docs_of(odd_rows, clashing=True), 20, 2, 20)
    assert df.columns[-2:] == ["n_words_", "n_removed_"]
    assert digest(df) == plain_substrings([r[:2] for r in odd_rows], 20)


def test_substrings_keep_white_space(docs_of):
    text = "p  q\n" + " ".join(f"w{i}" for i in range(6)) + "\n\n r s"
    got = {r["doc_id"]: r["text"] for r in substrings.dedup_substrings(docs_of([(1, " ".join(f"w{i}" for i in range(6))), (2, text)]), 5, 2, 16).collect()}
    assert got == {1: "w0 w1 w2 w3 w4 w5", 2: "p  q\nr s"}


def plain_tokens(text, path):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch(text, add_special_tokens=False)]


def test_token_counts(small, docs_of, odd_rows):
    rows = small[1] + [r[:2] for r in odd_rows] + [(99, "a<|endoftext|>b <|endoftext|>"), (98, "  two  spaces   "), (97, "don't 'S 's 12345")]
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs_of(rows)).collect())
    texts = [t or "" for _, t in rows]
    counted = plain_tokens(texts, token_counts.default_path())
    assert got == Counter((i, len(t.encode()), len(c), len(c) > 1024) for (i, _), t, c in zip(rows, texts, counted, strict=True))


def test_quality_counts(small, docs_of, odd_rows):
    rows = small[1] + [r[:2] for r in odd_rows]
    got = Counter(tuple(r) for r in quality_rules.statistics(docs_of(rows)).drop("features").collect())

    def plain(text):
        w = split(text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in (k, k + 1, k + 2)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if split(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)

    assert got == Counter((i, *plain(t)) for i, t in rows)


def plain_components(rows, size=4, least=85):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for _, text in rows:
        w = split((text or "").translate(low))
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        if rows[k][0] is not None:
            for g in s:
                holders[g].append(k)
    shared = Counter((a, b) for h in holders.values() for n, a in enumerate(h) for b in h[n + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= least * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(rows[a][0]), find(rows[b][0])
            root[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True))


def test_jaccard(small):
    df, rows = small
    assert Counter(tuple(r) for r in jaccard.near_duplicates(df).collect()) == plain_components(rows)


def test_jaccard_odd_rows(docs_of, odd_rows):
    got = Counter(tuple(r) for r in jaccard.near_duplicates(docs_of(odd_rows)).collect())
    assert got == plain_components([r[:2] for r in odd_rows])


def test_jaccard_groups_of_several_sets(docs_of):
    """Copies with one word changed, of which many share prefix and size, and texts whose parity bits differ in width."""
    rng = random.Random(11)
    rows = []
    for k in range(3):
        base = [f"b{k}_{rng.randrange(400)}" for _ in range(150)]
        for _ in range(40):
            copy = list(base)
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    for k in range(4):
        base = [f"l{k}_{rng.randrange(5000)}" for _ in range(1000 + 30 * k)]
        for n in (1, 20, 45, 60, 90):
            rows.append(" ".join([f"y{rng.randrange(10**6)}" if i % (len(base) // n) == 0 else w for i, w in enumerate(base)]))
        rows.append(" ".join(base + [f"q{i}" for i in range(110)]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    expected = plain_components(rows)
    assert len({c for _, _, c in expected}) > 6
    for rounds in (0, 2):
        assert Counter(tuple(r) for r in jaccard.near_duplicates(docs_of(rows), rounds=rounds).collect()) == expected
    signed = jaccard.signatures(docs_of(rows), 4, 85, docs_of(rows).sparkSession.sparkContext.broadcast((np.empty(0, np.uint64), np.empty(0, np.int64))))
    groups = signed.groupBy("same", "n").agg(F.countDistinct("a", "b").alias("k"))
    assert groups.filter("k > 1").count() > 5 and {r[0] for r in signed.selectExpr("size(parity)").distinct().collect()} == {16, 32}


def test_jaccard_chains_and_stars(docs_of):
    """Near copies around one text, a chain whose ends are unlike, and strangers with a common line."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(1000, " ".join(base))]
    for k in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 6])):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((rng.choice([1, 2000]) + k, " ".join(w)))
    line = [f"l{i}" for i in range(25)]
    rows += [(5000 + k, " ".join(line + [f"u{k}_{i}" for i in range(rng.randrange(2, 30))])) for k in range(60)]
    chain = [f"c{i}" for i in range(300)]
    for k in range(12):
        rows.append((8000 + k, " ".join(chain[k * 10:k * 10 + 160])))
    expected = plain_components(rows)
    for rounds in (0, 3):
        assert Counter(tuple(r) for r in jaccard.near_duplicates(docs_of(rows), rounds=rounds).collect()) == expected


def test_keep_one_of_each(docs_of, odd_rows):
    df = docs_of(odd_rows, clashing=True)
    kept = jaccard.keep_one_of_each(df)
    assert kept.columns == df.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter({1: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 10: 1, 11: 1, 12: 1})


def check_packing(rows, pieces, sequences_at_most=None):
    ids = plain_tokens([t or "" for _, t in rows], packing.default_path())
    import numpy as np

    expected = Counter()
    for (i, _), own in zip(rows, ids, strict=True):
        own = [*own, 0]
        for k, at in enumerate(range(0, len(own), 2048)):
            part = np.array(own[at:at + 2048], "<u4")
            expected[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == expected
    held = defaultdict(list)
    for r in pieces:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    if sequences_at_most is not None:
        assert len(held) <= sequences_at_most
    return len(held)


def test_packing(small, docs_of, odd_rows):
    df, rows = small
    used = check_packing(rows, packing.pack(df).collect())
    total = sum(len(x) + 1 for x in plain_tokens([t for _, t in rows], packing.default_path()))
    assert used <= -(-total // 2048) * 1.03 + 1
    rows = [r[:2] for r in odd_rows]
    check_packing(rows, packing.pack(docs_of(odd_rows, clashing=True)).collect())


def test_plan_fills_exactly():
    assert packing.Plan({1024: 7}).sequences == 4
    assert packing.Plan({2000: 3, 48: 2, 24: 2}).sequences == 3
    assert packing.Plan({1500: 1, 300: 1, 200: 1, 48: 1}).patterns == [((1500, 300, 200, 48), 1)]
    assert packing.Plan({2048: 5, 1: 4}).sequences == 6
    assert packing.Plan({}).sequences == 0
    assert packing.Plan({x: 1000 for x in range(1, 2048)}).sequences <= 1000 * 2047 // 2 + 2


def test_word_ids_equal_whole_texts():
    import numpy as np
    from tokenizers import Tokenizer

    rng, own = random.Random(1), packing.WordIds(packing.default_path())
    whole = Tokenizer.from_file(packing.default_path())
    bits = ["a", "B", "é", "É", "İ", "é", ".", ",", "!", "'s", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "9", "٣", "ß", "Σ", " ", "\n", " ", "中", "́", "K"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_word_ids_compose_before_lower_case():
    """A capital with a mark that has no composed form, though its small letter with the mark has one."""
    import numpy as np
    from tokenizers import Tokenizer

    own, whole = packing.WordIds(packing.default_path()), Tokenizer.from_file(packing.default_path())
    for text in ("H\u0331afiz", "J\u030c", "T\u0308", "W\u030a", "Y\u030a", "The H\u0331AFIZ, J\u030c. AND W\u030aord! <|x T\u0308"):
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_winnowing_guarantee(docs_of):
    """Texts that share GRAM + WINDOW - 1 units share a fingerprint; positions point at the picked grams."""
    rng = random.Random(2)
    shared = [f"s{i}" for i in range(fingerprints.GRAM + fingerprints.WINDOW - 1)]
    rows = []
    for k in range(40):
        fill = lambda: [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]  # noqa: B023, E731
        rows.append((k, " ".join([*fill(), *shared, *fill()])))
    got = fingerprints.fingerprint(docs_of(rows)).collect()
    common = set.intersection(*[set(r["fingerprint"]) for r in got])
    assert common
    for r in got:
        w, at = r["text"].split(), dict(zip(r["fingerprint"], r["fingerprint_at"], strict=True))
        assert {" ".join(w[at[h]:at[h] + 3]) for h in common} <= {" ".join(shared[i:i + 3]) for i in range(len(shared) - 2)}
    grams = {tuple(r["text"].split()[a:a + 3]): h for r in got for h, a in zip(r["fingerprint"], r["fingerprint_at"], strict=True)}
    assert len(set(grams.values())) == len(grams)


def test_winnowing_picks_rightmost_minimum(docs_of):
    """All grams equal: every window picks its last one."""
    r = fingerprints.fingerprint(docs_of([(1, "a " * 20)])).first()
    n = 18  # grams of 3 words
    assert sorted(r["fingerprint_at"]) == list(range(fingerprints.WINDOW - 1, n)) and len(set(r["fingerprint"])) == 1


def test_winnowing_without_spaces(docs_of):
    """In long runs a unit starts at each code point: a passage's fingerprints do not depend on its offset."""
    rng, n = random.Random(7), fingerprints.UNIT
    shared = n + fingerprints.GRAM + fingerprints.WINDOW - 2  # code points of GRAM + WINDOW - 1 units
    draw = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    han, base64 = [chr(0x4E00 + i) for i in range(3000)] + ["\U00020000"], "abcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [draw(300, han), draw(300, base64), *(mark.join(draw(6, base64) for _ in range(60)) for mark in "\u00a0\u3000")]
    for text in texts:
        cut = text[40:40 + shared]
        for at in (1, 7, 16):
            rows = [(1, text), (2, draw(at, han) + text), (3, draw(at + n, han) + cut + draw(n + 1, han))]
            found = {r["doc_id"]: set(r["fingerprint"]) for r in fingerprints.fingerprint(docs_of(rows, parts=1)).collect()}
            assert len(found[1] - found[2]) <= 1 and found[1] & found[3]
    edits = fingerprints.neighbour_edits(docs_of([(1, texts[0]), (2, "x" + texts[0])])).collect()
    assert all(r["near_next"] > 0.9 for r in edits)


def test_units(spark):
    def plain(text, n=4):
        return [p for w in split(text) for p in ([w] if len(w) <= n else [w[i:i + n] for i in range(len(w) - n + 1)])]

    texts = ["", " ", "a", "abcd", "abcde", " ab\nabcd abcdef\u00a0\u3000gh x ", "\U0001f600" * 5 + " é\v中文字", "a" * 4 + "\t" + "b" * 9]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in frame.coalesce(1).select(fingerprints.units(F.col("text"), 4)).collect()] == [plain(t) for t in texts]


def plain_edits(rows):
    """doc_id, n_chars and digest of the edited text, over distinct rows in id order (ids are unique here)."""
    rows = sorted(rows)
    out = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        out[i] = (len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest())
    return out


def test_fingerprint_edits(small, docs_of):
    df, rows = small
    for frame, plain in ((df, rows), (docs_of([(1, "only one text of some words")]), [(1, "only one text of some words")])):
        got = fingerprints.neighbour_edits(frame).collect()
        assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == plain_edits(plain)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    text = dict(rows)
    by_text = defaultdict(set)
    for r in fingerprints.neighbour_edits(df).collect():
        by_text[text[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprint_odd_rows(docs_of, odd_rows):
    got = fingerprints.neighbour_edits(docs_of(odd_rows, clashing=True)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({i: len({t or "" for j, t, _ in odd_rows if j == i}) for i in {r[0] for r in odd_rows}})
    empty = next(r for r in got if r["doc_id"] == 4)
    assert (empty["n_chars"], empty["fingerprint"], empty["near_edited"]) == (0, "", 1.0)


def test_mixing_odd_rows(docs_of, odd_rows):
    df = docs_of(odd_rows, clashing=True)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    size = lambda t: len(split(t))
    total = sum(size(r[1]) for r in odd_rows)
    taken = [r for r in mixed.collect()]
    assert sum(size(r["text"]) for r in taken) <= 1.5 * total
    rows = Counter(r[:2] for r in odd_rows)
    for row, n in Counter((r["doc_id"], r["text"]) for r in taken).items():
        assert n <= 2 * rows[row]
    assert Counter((r["doc_id"], r["text"]) for r in mixing.mix_documents(df.repartition(7)).collect()) == Counter((r["doc_id"], r["text"]) for r in taken)


def test_mixing_targets(docs_of):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "c", None][i % 4 if i % 3 else 0]) for i in range(400)]
    out = mixing.fair_queue(mixing.sized(docs_of(rows))).filter("taken").groupBy("source").agg(
        F.sum("size").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
    assert sum(r["target"] for r in out) == pytest.approx(1.5 * sum(r["size"] for r in out))
    for r in out:
        assert abs(r["taken"] - r["target"]) <= 7 and r["target"] <= 2 * r["size"]


def test_revisits(spark):
    url = "http://Www.Host.org/a/?utm_source=x&ref=1#top"
    head = {"Content-Type": "t", "ETag": '"1"', "Date": "d0"}
    rows = [
        (1, "https://host.org/a", 10, "response", '"1"', None, head, "one"), (2, url, 20, "response", '"2"', None, {"Date": "d1"}, "two"),
        (3, url, 20, "revisit", 'W/"2"', None, {"date": "d2", "Content-Length": "0"}, None), (4, url, 15, "revisit", '"2"', None, None, None),
        (5, url, 5, "revisit", '"1"', None, {}, None), (6, "http://other.org/", 50, "revisit", None, None, {}, None), (7, None, 9, "revisit", '"1"', None, {}, None),
        (8, url, 30, "revisit", None, "m", {}, None), (9, url, None, "revisit", '"1"', None, {}, None), (10, "https://host.org/a", 12, "revisit", '"1"', None, {}, None),
    ]
    kinds = "record_id long, url string, time long, kind string, etag string, last_modified string, headers map<string,string>, digest string, Site int"
    df = spark.createDataFrame([(*r, 1) for r in rows], kinds)
    got = {r["record_id"]: (r["target_id"], r["outcome"], r["headers"], r["digest"]) for r in revisits.resolve(df).collect()}
    assert got == {
        3: (2, "resolved", {"date": "d2"}, "two"), 4: (1, "mismatch", None, None), 5: (None, "missing", None, None), 6: (None, "missing", None, None),
        7: (None, "missing", None, None), 8: (2, "unchecked", None, None), 9: (None, "missing", None, None),
        10: (1, "resolved", {"content-type": "t", "etag": '"1"', "date": "d0"}, "one"),
    }
    assert revisits.resolve(df.limit(0)).count() == 0


REVISIT_KINDS = "record_id long, url string, time long, kind string, etag string, last_modified string, headers map<string,string>, digest string"


def test_revisits_header_case_and_repeated_rows(spark):
    """Names that differ in case only: the last in byte order counts. Rows given twice multiply nothing; null ids and other kinds are allowed."""
    url = "http://h.org/a"
    full = (1, url, 10, "response", '"1"', None, {"ETag": '"0"', "etag": '"1"', "X": "1", "x": "2"}, "one")
    again = (2, url, 20, "revisit", '"1"', None, {"Date": "d1", "date": "d2"}, None)
    rows = [full, full, again, again, (None, url, 21, "revisit", '"1"', None, None, None), (None, "http://n.org", 1, "response", None, "m", None, "two"),
            (5, "http://n.org", 2, "revisit", None, "m", None, None), (6, url, 30, "request", None, None, None, None)]
    got = [(r["record_id"], r["target_id"], r["outcome"], r["headers"], r["digest"]) for r in revisits.resolve(spark.createDataFrame(rows, REVISIT_KINDS)).collect()]
    stored = {"etag": '"1"', "x": "2"}
    assert sorted(got, key=str) == sorted([
        (2, 1, "resolved", stored | {"date": "d2"}, "one"), (2, 1, "resolved", stored | {"date": "d2"}, "one"),
        (None, 1, "resolved", stored, "one"), (5, None, "resolved", {}, "two"),
    ], key=str)


def test_revisits_of_one_time_and_id(spark):
    """Of responses of one time and id the last by tag counts, wherever rows lie; one of the revisit's own time and id does not."""
    rows = [(1, "u.org", 5, "response", tag, None, {}, tag) for tag in ("a", "c", "b")]
    rows += [(2, "u.org", 6, "revisit", "c", None, {}, None), (2, "u.org", 6, "response", "z", None, {}, "z")]
    for order in (rows, rows[::-1]):
        got = revisits.resolve(spark.createDataFrame(order, REVISIT_KINDS).repartition(3)).collect()
        assert [(r["record_id"], r["target_id"], r["outcome"], r["digest"]) for r in got] == [(2, 1, "resolved", "c")]


@pytest.mark.parametrize("a, b, same", [
    ("http://h.org:80/a%7Eb", "https://www.H.org/a~b/", True), ("http://h.org/?x=1&y=2", "http://h.org?y=2&x=1#t", True),
    ("http://h.org:443", "h.org", True), ("http://h.org:8080/", "http://h.org/", False), ("http://h.org/%2fa", "http://h.org/%2Fa", True),
    ("http://h.org/%2fa", "http://h.org//a", False), ("http://h.org/a?ref=1&b=2&utm_x=3", "http://h.org/a?b=2", True), ("http://h.org/a?preref=1", "http://h.org/a", False),
    ("http://h.org/a?b", "http://h.org/a", False), ("http://h.org/100%", "http://h.org/100", False), ("http://h.org/%C3%a9", "http://h.org/%c3%A9", True), ("", "http://", True),
])
def test_canonical_urls(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(revisits.canonical_url(F.col("a")), revisits.canonical_url(F.col("b"))).first()
    assert row[0] is not None and (row[0] == row[1]) == same


def test_revisits_of_one_hot_url(spark):
    """One site over many ranges: what a range inherits comes from the one before."""
    n = 3000
    rows = spark.range(n).selectExpr(
        "id AS record_id", "'http://hot.org/x' AS url", "id AS time", "IF(id % 700 = 3, 'response', 'revisit') AS kind", "'\"1\"' AS etag",
        "CAST(NULL AS STRING) AS last_modified", "map('a', 'b') AS headers", "'d' AS digest")
    got = {r["record_id"]: r["target_id"] for r in revisits.resolve(rows.repartition(5)).collect()}
    last, expected = None, {}
    for i in range(n):
        if i % 700 == 3:
            last = i
        else:
            expected[i] = last
    assert got == expected


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    cursor = con.execute(all_oracles()[name])
    got = all_queries()[name](spark, SMALL)
    order = [d[0] for d in cursor.description]
    assert sorted(order) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(*order).collect()) == Counter(cursor.fetchall())


def test_empty_tables(spark, docs_of):
    none = docs_of([(1, "x")]).filter("doc_id > 5")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert substrings.dedup_substrings(none, 5, 2, 16).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    assert quality_rules.apply_rules(none, quality_rules.fit_rules(none, labels)).count() == 0
    assert jaccard.near_duplicates(none).count() == 0
    assert jaccard.keep_one_of_each(none).count() == 0
    assert toxicity.drop_toxic(none, labels).count() == 0
    assert packing.pack(none).count() == 0
    assert fingerprints.neighbour_edits(none).count() == 0
    assert mixing.mix_documents(none).count() == 0
