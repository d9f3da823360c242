"""Memory and disk that operators take beside their results."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from panelkit import session
from panelkit.llm import jaccard, packing, substrings, textarrays, toxicity, workers
from panelkit.llm.chain import Chain
from panelkit.llm.components import components, stars
from panelkit.llm.sketches import Bits, Parts, _unpack, cells


def test_parts_of_a_sketch_hold_the_cells_of_their_keys():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 1 << 18, dtype=np.uint64)
    keys[: 1 << 10] = keys[1 << 10 : 1 << 11]
    parts, out = Parts(2, 24), []
    for at in range(0, len(keys), 1 << 14):
        out += parts.add(keys[at : at + (1 << 14)], keys[at : at + (1 << 14)])
    out += parts.flush()
    for row in range(2):
        cell, count = np.unique(cells(keys, keys, row, 24), return_counts=True)
        for which, wanted in (("seen", cell), ("again", cell[count > 1])):
            got = [(b - row * 8 << 21) + _unpack(p) for batch in out for b, p in zip(batch["block"].to_pylist(), batch[which].to_pylist(), strict=True) if b // 8 == row]
            assert np.array_equal(np.concatenate(got), wanted)


def test_no_task_that_cuts_passages_has_two_python_workers(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), (2, "x " + passage + " y"), (3, "a b"), (4, None), (None, passage), (5, "")]
    cut = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), log_cells=20)
    depth, workers = 0, []
    for line in cut._jdf.queryExecution().sparkPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        workers = [d for d in workers if d < depth]
        if "Join" in line:
            workers = []  # its sides are shuffled
        if "MapInArrow" in line:
            assert not workers, line
            workers.append(depth)
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in cut.collect()}
    assert got == {1: (passage, 60, 0), 2: ("x y", 62, 60), 3: ("a b", 2, 0), 4: (None, 0, 0), None: (passage, 60, 0), 5: ("", 0, 0)}


def test_fit_of_a_chain_holds_few_numbers_for_each_word():
    rng, n = np.random.default_rng(2), 400_000
    features, state = rng.integers(0, 1 << 18, (n, 4)).astype(np.int32), (rng.random(n) < 0.05).astype(np.int64)
    tracemalloc.start()
    try:
        Chain().fit(features, np.append(np.arange(0, n, 256), n), state, steps=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120 * n, peak / n  # bytes for each word, weights included


def test_jaccard_join_leaves_no_older_states_of_its_lists(spark):
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"{common} a{i // 3} b{i // 3} x{i}") for i in range(30)] + [(90, "no other has this"), (91, None)]
    before = len(session._WRITTEN)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    names = [path.rsplit("/", 1)[1].split("-")[0] for path in session._WRITTEN[before:]]
    assert not {"lists", "parity"} & set(names), names
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert got == {i: 0 for i in range(30)} | {90: 90, 91: 91}


def test_a_sketch_holds_the_cells_and_not_the_keys_of_a_task():
    n = 1 << 19
    tracemalloc.start()
    try:
        rng, parts = np.random.default_rng(3), Parts(2, 28)
        for _ in range(0, n, 1 << 14):
            list(parts.add(*rng.integers(0, 1 << 63, (2, 1 << 14), dtype=np.uint64)))
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        for _ in parts.flush():
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held < 10 * n and peak < 20 * n, (held / n, peak / n)  # bytes for each key


def test_workers_that_cut_passages_get_short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        docs = spark.range(0, 5000, 1, 1).selectExpr("id AS doc_id", "concat('word ', id) AS text")
        assert substrings.dedup_substrings(docs, log_cells=20).filter("n_removed = 0").count() == 5000
        sizes = [r.n for r in docs.mapInArrow(lambda batches: (pa.record_batch({"n": [b.num_rows]}) for b in batches), "n long").collect()]
        assert max(sizes) <= workers.ROWS and sum(sizes) == 5000
        spark.conf.set(name, "100")
        workers.short_batches(spark)
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)


def test_components_of_a_star_take_one_look_and_chains_end(spark):
    before = len(session._WRITTEN)
    star = spark.createDataFrame([(7, 1), (1, 5), (7, 1), (3, 3), (9, 8)], "u long, v long")
    assert sorted(map(tuple, stars(star).collect())) == [(5, 1), (7, 1), (9, 8)]
    assert len(session._WRITTEN) == before + 1  # the links, and no state after them
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(101, 100)], "u int, v int")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_jaccard_join_runs_few_tasks(spark):
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"{common} a{i // 3} b{i // 3} x{i}") for i in range(30)] + [(90, "no other has this"), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    sc.setJobGroup("few", "few")
    try:
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    ran = {i for job in tracker.getJobIdsForGroup("few") for i in tracker.getJobInfo(job).stageIds}
    assert got == {i: 0 for i in range(30)} | {90: 90, 91: 91}
    assert 0 < len(ran) < 160, len(ran)


class _Handed:
    """Stands for a frame and its session: ``mapInArrow`` hands out the task itself."""

    columns = ["doc_id", "text"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    value = None

    @property
    def sparkSession(self):
        return self

    sparkContext = sparkSession

    def broadcast(self, value):
        shared = _Handed()
        shared.value = value
        return shared

    def select(self, *_):
        return self

    def mapInArrow(self, task, _):
        return task


def _batch(seed: int, texts: int = 2000, words: int = 300) -> pa.RecordBatch:
    rng = np.random.default_rng(seed)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 10**5, words)) for _ in range(texts)]
    return pa.record_batch({"doc_id": pa.array(range(texts), pa.int64()), "text": pa.array(text)})


def _peak(task, batches) -> int:
    tracemalloc.start()
    try:
        for _ in task(batches):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_packing_remembers_a_bounded_number_of_words_and_keeps_common_ones(monkeypatch):
    own, whole = packing.WordIds(packing.default_path()), packing.WordIds(packing.default_path()).tokenizer
    for at in range(0, 900_000, 3000):
        own.ids(" ".join(str(at + i) for i in range(3000)).encode())
    assert sum(len(held) for held in (own.known, getattr(own, "older", {}))) < 600_000

    monkeypatch.setattr(packing, "REMEMBERED", 100)
    own, learned = packing.WordIds(packing.default_path()), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda fresh: (learned.extend(fresh), learn(fresh)))
    for i in range(300):
        text = f"common Other. n{i} m{i}, é{i} common"
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert learned.count(b"common") == learned.count(b"other.") == 1
    assert len(own.known) <= 110 and len(own.older) <= 110


def test_tasks_hold_little_beside_their_batch():
    batch = _batch(1)
    size = batch.nbytes
    scored = toxicity.tag(_Handed(), toxicity.Tagger(Chain(), np.zeros(2)), spans=None)
    assert 3 << 20 < size < 5 << 20
    assert _peak(scored, [batch]) < 70 << 20
    every = _Handed().broadcast(Bits([np.full(1 << 17, 255, np.uint8)] * 2, 20))
    assert _peak(substrings.document_ends(_Handed(), every, 50), [batch]) < 40 << 20


def test_tasks_leave_no_powers_to_the_next():
    hashes = workers.tidy(lambda batches: ([x.word_hash() for x in textarrays.blocks(b["text"])] for b in batches))
    for _ in hashes([_batch(2, 20)]):
        assert textarrays._POWERS
    assert not textarrays._POWERS


def test_a_bitmap_arrives_without_a_second_copy_of_its_rows():
    rng = np.random.default_rng(4)
    rows = [np.where(rng.random(1 << 20) < 0.05, 8, 0).astype(np.uint8) for _ in range(4)]
    sent = pickle.dumps(Bits(rows, 23))
    tracemalloc.start()
    try:
        got = pickle.loads(sent)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.log_cells == 23 and all(np.array_equal(a, b) for a, b in zip(got.rows, rows, strict=True))
    assert peak < (4 << 20) + 2 * len(sent), (peak, len(sent))
