"""Histogram gradient boosting as Spark jobs.

Features are binned once. A job sums gradients, hessians and rows for each (tree, node, feature, bin); the sums merge like
any aggregate, Spark SQL finds the best split of each node, and only that split reaches the driver. All trees of all
models under construction share a job, so classes, folds and settings of a search cost one pass together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .metrics import class_report, report_averages

#: Bins of a feature. Bin 0 holds nulls; the others are cut at distinct values, or at quantiles where there are more values.
BINS = 64
#: Iterations after which the rows' scores are written, so that later passes walk few trees.
WRITTEN = 8
#: Least hessian on either side of a split.
LEAST_HESSIAN = 1e-3


@dataclass(frozen=True)
class Setting:
    """Learning rate, leaves of a tree at most, rows of a leaf at least, L2 penalty on leaf values, levels at most (0: any)."""

    step: float = 0.1
    leaves: int = 31
    least: int = 20
    l2: float = 0.0
    depth: int = 0


@dataclass
class Tree:
    """Nodes in arrays; a node without children (-1) is a leaf. Codes up to ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for column, start in ((self.feature, 0), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(start)
        return len(self.feature) - 1

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        feature, cut, left, right = (np.asarray(x) for x in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(codes), np.int64)
        going = np.flatnonzero(left[node] >= 0)
        while len(going):
            at = node[going]
            low = codes[going, feature[at]] <= cut[at]
            node[going] = np.where(low, left[at], right[at])
            going = going[left[node[going]] >= 0]
        return node

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaf(codes)]


@dataclass
class Boosted:
    """One model. ``fold`` k trains on the blocks before k; 0 trains on all rows. Two classes have one tree an iteration."""

    name: str
    setting: Setting
    classes: int
    fold: int = 0
    base: list[float] = field(default_factory=list)
    trees: list[list[Tree]] = field(default_factory=list)

    @property
    def outputs(self) -> int:
        return 1 if self.classes == 2 else self.classes

    def raw(self, codes: np.ndarray, done: int = 0) -> np.ndarray:
        """Sums of the trees from iteration ``done`` on."""
        out = np.zeros((len(codes), self.outputs))
        for row in self.trees[done:]:
            for k, tree in enumerate(row):
                out[:, k] += tree.scores(codes)
        return out

    def chances(self, raw: np.ndarray) -> np.ndarray:
        raw = raw + np.asarray(self.base)
        if self.classes == 2:
            p = 1 / (1 + np.exp(-np.clip(raw[:, 0], -35, 35)))
            return np.stack([1 - p, p], 1)
        e = np.exp(raw - raw.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


@dataclass(frozen=True)
class Bins:
    """Features and the upper bounds of their bins, the last bin being open."""

    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]

    def codes(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns[0]), len(columns)), np.uint8)
        for k, x in enumerate(columns):
            out[:, k] = np.where(np.isnan(x), 0, np.searchsorted(np.asarray(self.edges[k]), x, "left") + 1)
        return out


def fit_bins(df: DataFrame, features: Sequence[str], bins: int = BINS) -> Bins:
    """Bins of the features: one for each value where there are few, else between approximate quantiles."""
    if bins > 254:
        raise ValueError("codes are bytes: 254 bins at most")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], list(features), "feature", "x").filter("x IS NOT NULL")
    values = long.groupBy("feature", "x").agg(F.count("*").alias("n"))
    few = values.groupBy("feature").agg(F.count("*").alias("k")).filter(F.col("k") <= bins).select("feature")
    exact = values.join(few, "feature").groupBy("feature").agg(F.array_sort(F.collect_set("x")).alias("e"))  # up to ``bins`` values
    probs = [k / bins for k in range(1, bins)]
    rough = long.join(few, "feature", "left_anti").groupBy("feature").agg(F.array_distinct(F.percentile_approx("x", probs, 10_000)).alias("e"))
    found = {r["feature"]: r["e"] for r in exact.union(rough).collect()}  # one row a feature
    return Bins(tuple(features), tuple(tuple(float(v) for v in found.get(c) or ()) for c in features))


def binned(df: DataFrame, bins: Bins, label: str, weight: str | None = None, block: str | None = None) -> DataFrame:
    """``codes, label, weight, block`` of the rows, written once. Without ``block`` all rows are of block 0."""
    picked = df.select(
        *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(bins.features)], F.col(label).cast("int").alias("label"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), (F.col(block) if block else F.lit(0)).cast("int").alias("block"),
    )

    def code(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(bins.features))]
            codes = bins.codes(columns)
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in codes], pa.binary()), *(batch.column(c) for c in ("label", "weight", "block"))],
                                             ["codes", "label", "weight", "block"])

    return cut_lineage(picked.mapInArrow(code, "codes binary, label int, weight double, block int"), "codes")


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, width)


class Boosting:
    """Boosts models together over the same rows. ``fit`` may be called again: it goes on from the trees that are there."""

    def __init__(self, rows: DataFrame, bins: Bins, models: Sequence[Boosted]):
        self.rows, self.bins, self.models = rows, bins, list(models)
        self.scored, self.done = rows.withColumn("raw", F.lit(b"")), {m.name: 0 for m in self.models}
        priors = rows.groupBy("block", "label").agg(F.sum("weight").alias("w")).collect()  # one row a block and class
        for m in self.models:
            if not m.base:
                mass = np.array([sum(r["w"] for r in priors if r["label"] == k and (m.fold == 0 or r["block"] < m.fold)) for k in range(m.classes)])
                p = np.maximum(mass, 1e-9) / max(mass.sum(), 1e-9)
                m.base = [float(np.log(p[1] / p[0]))] if m.classes == 2 else [float(v) for v in np.log(p)]

    def fit(self, iterations: int, models: Sequence[Boosted] | None = None) -> None:
        alive = self.models if models is None else list(models)
        for k in range(iterations):
            grown = self._grow(alive)
            for m in alive:
                m.trees.append(grown[m.name])
            if (k + 1) % WRITTEN == 0 and k + 1 < iterations:
                self._write_scores()

    def _batches(self):
        """A task's view of a batch: codes and, for each model, the raw scores."""
        models, done, width = self.models, dict(self.done), len(self.bins.features)

        def view(batch: pa.RecordBatch, wanted):
            codes = _matrix(batch, width)
            written = b"".join(batch.column("raw").to_pylist())
            old = np.frombuffer(written, np.float64).reshape(len(codes), -1) if written else None
            at, out = 0, {}
            for m in models:
                if m.name in wanted:
                    raw = m.raw(codes, done[m.name])
                    out[m.name] = raw if old is None else raw + old[:, at : at + m.outputs]
                at += m.outputs
            return codes, out

        return view

    def _write_scores(self) -> None:
        view, names = self._batches(), [m.name for m in self.models]

        def score(batches: Iterable[pa.RecordBatch]):
            for batch in batches:
                _, raw = view(batch, names)
                whole = np.concatenate([raw[n] for n in names], 1)
                columns = [batch.column(c) for c in ("codes", "label", "weight", "block")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in whole], pa.binary())], ["codes", "label", "weight", "block", "raw"])

        self.scored = cut_lineage(self.scored.mapInArrow(score, "codes binary, label int, weight double, block int, raw binary"), "raw")
        self.done = {m.name: len(m.trees) for m in self.models}

    def _grow(self, alive: Sequence[Boosted]) -> dict[str, list[Tree]]:
        """The next trees, grown best split first. A pass sums the histograms of all nodes whose split is sure to be wanted
        if no better one turns up below, so that passes are as many as levels, not as leaves."""
        trees = {m.name: [Tree() for _ in range(m.outputs)] for m in alive}
        sums: dict[tuple[str, int], dict[int, dict]] = {(m.name, k): {} for m in alive for k in range(m.outputs)}
        wanted, levels = {key: [0] for key in sums}, {key: {0: 0} for key in sums}
        settings = {m.name: m.setting for m in alive}
        while wanted:
            for r in self.splits_of(alive, trees, wanted).collect():  # one row a node
                sums[r["model"], r["output"]][r["node"]] = r.asDict()
            wanted = {}
            for (name, k), known in sums.items():
                tree, new, level = trees[name][k], [], levels[name, k]
                for node in _chosen(tree, known, settings[name].leaves):
                    if tree.left[node] < 0:
                        own = known[node]
                        tree.feature[node], tree.bin[node] = own["feature"], own["bin"]
                        tree.left[node], tree.right[node] = sides = tree.add(), tree.add()
                        # sums of both sides follow from the split; without a pass they have no split of their own
                        known[sides[0]] = {"g": own["g_l"], "h": own["h_l"], "gain": None}
                        known[sides[1]] = {"g": own["g"] - own["g_l"], "h": own["h"] - own["h_l"], "gain": None}
                        level[sides[0]] = level[sides[1]] = level[node] + 1
                        if not 0 < settings[name].depth <= level[node] + 1:
                            new += sides
                if new:
                    wanted[name, k] = new
        for (name, k), known in sums.items():
            tree, setting = trees[name][k], settings[name]
            kept = set(_chosen(tree, known, setting.leaves))
            for node in range(len(tree.feature)):
                if node not in kept:
                    tree.left[node] = tree.right[node] = -1
                if node in known:
                    tree.value[node] = -setting.step * known[node]["g"] / (known[node]["h"] + setting.l2 + 1e-12)
        return trees

    def splits_of(self, alive, trees, wanted) -> DataFrame:
        """For each wanted node its sums and best split: ``model, output, node, g, h, feature, bin, gain, g_l, h_l`` (null without any)."""
        view, width, names = self._batches(), len(self.bins.features), [m.name for m in alive]
        size = max([len(e) for e in self.bins.edges], default=0) + 2
        models = list(alive)

        def histograms(batches: Iterable[pa.RecordBatch]):
            total: dict[tuple, np.ndarray] = {}
            for batch in batches:
                codes, raws = view(batch, names)
                label, weight, block = (batch.column(c).to_numpy() for c in ("label", "weight", "block"))
                for m in models:
                    rows = np.arange(len(codes)) if m.fold == 0 else np.flatnonzero(block < m.fold)
                    p = m.chances(raws[m.name][rows])
                    for k in range(m.outputs):
                        if (m.name, k) not in wanted:
                            continue
                        chance, hit = (p[:, 1], label[rows] == 1) if m.classes == 2 else (p[:, k], label[rows] == k)
                        g, h = (chance - hit) * weight[rows], chance * (1 - chance) * weight[rows]
                        place = np.full(len(trees[m.name][k].feature), -1)
                        place[wanted[m.name, k]] = np.arange(len(wanted[m.name, k]))
                        slot = place[trees[m.name][k].leaf(codes[rows])]
                        inside = np.flatnonzero(slot >= 0)
                        cell = (slot[inside, None] * width + np.arange(width)) * size + codes[rows][inside]
                        n = len(wanted[m.name, k]) * width * size
                        sums = [np.bincount(cell.ravel(), np.repeat(x[inside], width), n) for x in (g, h, np.ones(len(rows)))]
                        total[m.name, k] = total.get((m.name, k), 0) + np.stack(sums).astype(float)  # no rows give whole numbers
            for (name, k), sums in total.items():
                used = np.flatnonzero(sums[2])
                slot, rest = np.divmod(used, width * size)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(used), pa.string()), pa.array(np.full(len(used), k, np.int32)), pa.array(np.asarray(wanted[name, k], np.int32)[slot]),
                    pa.array((rest // size).astype(np.int32)), pa.array((rest % size).astype(np.int32)), *(pa.array(s[used]) for s in sums),
                ], ["model", "output", "node", "feature", "bin", "g", "h", "n"])

        cells = self.scored.mapInArrow(histograms, "model string, output int, node int, feature int, bin int, g double, h double, n double")
        return best_splits(cells, {m.name: m.setting for m in alive})

    def confusion(self, models: Sequence[Boosted]) -> DataFrame:
        """Counts per (model, truth, predicted) over the block that each model's fold holds out."""
        view, names, tried = self._batches(), [m.name for m in models], list(models)

        def score(batches: Iterable[pa.RecordBatch]):
            counts: dict[tuple, int] = {}
            for batch in batches:
                _, raws = view(batch, names)
                label, block = (batch.column(c).to_numpy() for c in ("label", "block"))
                for m in tried:
                    rows = np.flatnonzero(block == m.fold)
                    pairs = label[rows].astype(np.int64) * m.classes + m.chances(raws[m.name][rows]).argmax(1)
                    for pair, n in zip(*np.unique(pairs, return_counts=True)):
                        key = m.name, int(pair) // m.classes, int(pair) % m.classes
                        counts[key] = counts.get(key, 0) + int(n)
            if counts:
                yield pa.RecordBatch.from_pylist([{"model": a, "truth": b, "predicted": c, "n": n} for (a, b, c), n in counts.items()], pa.schema(
                    [("model", pa.string()), ("truth", pa.int32()), ("predicted", pa.int32()), ("n", pa.int64())]))

        partial = self.scored.mapInArrow(score, "model string, truth int, predicted int, n long")
        return partial.groupBy("model", "truth", "predicted").agg(F.sum("n").alias("n"))


def best_splits(cells: DataFrame, settings: dict[str, Setting]) -> DataFrame:
    """Best split of each node from its cells (``model, output, node, feature, bin, g, h, n``), which may be parts to be summed.

    The gain is the fall of the penalised loss. Of equal gains the first feature and the lowest bin win. Cells are dealt out
    by node once, for the sums, the running sums and the choice: a node has as many cells as features have bins.
    """
    node = ["model", "output", "node"]
    merged = cells.repartition(*node).groupBy(*node, "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    upto = W.partitionBy(*node, "feature").orderBy("bin")
    whole = W.partitionBy(*node, "feature")
    spread = merged.select(*node, "feature", "bin", *[F.sum(c).over(w).alias(c + side) for c in ("g", "h", "n") for w, side in ((upto, "_l"), (whole, ""))])
    of = lambda x: F.element_at(F.create_map(*[F.lit(v) for name, s in settings.items() for v in (name, float(getattr(s, x)))]), F.col("model"))
    l2, least = of("l2"), of("least")
    left, right = F.col("h_l"), F.col("h") - F.col("h_l")
    loss = lambda g, h: g * g / (h + l2 + 1e-12)
    gain = loss(F.col("g_l"), left) + loss(F.col("g") - F.col("g_l"), right) - loss(F.col("g"), F.col("h"))
    allowed = (F.col("n_l") >= least) & (F.col("n") - F.col("n_l") >= least) & (left >= LEAST_HESSIAN) & (right >= LEAST_HESSIAN) & (gain > 1e-9)
    split = F.when(allowed, F.struct((-F.round(gain, 9)).alias("loss"), "feature", "bin", "g_l", "h_l"))
    one = F.col("feature") == F.min("feature").over(W.partitionBy(*node))
    marked = spread.withColumns({"split": split, "one": one})
    best = marked.groupBy(*node).agg(F.max(F.when(F.col("one"), F.col("g"))).alias("g"), F.max(F.when(F.col("one"), F.col("h"))).alias("h"), F.min("split").alias("s"))
    return best.select(*node, "g", "h", F.col("s.feature").alias("feature"), F.col("s.bin").alias("bin"), (-F.col("s.loss")).alias("gain"), F.col("s.g_l").alias("g_l"), F.col("s.h_l").alias("h_l"))


def _chosen(tree: Tree, known: dict[int, dict], leaves: int) -> list[int]:
    """Nodes that growing best split first would split, as far as splits are known."""
    heap, out = [], []

    def offer(node: int) -> None:
        if node in known and known[node]["gain"] is not None:
            heapq.heappush(heap, (-known[node]["gain"], node))

    offer(0)
    while heap and len(out) < leaves - 1:
        node = heapq.heappop(heap)[1]
        out.append(node)
        if tree.left[node] >= 0:
            offer(tree.left[node])
            offer(tree.right[node])
    return out


def predict(df: DataFrame, bins: Bins, model: Boosted) -> DataFrame:
    """``df`` with ``probabilities`` and ``prediction``."""
    x = [f"_x{k}" for k in range(len(bins.features))]
    wide = df.select("*", *[F.col(c).cast("double").alias(n) for n, c in zip(x, bins.features)])
    kept = df.columns
    schema = df.limit(0).selectExpr("*", "CAST(NULL AS ARRAY<DOUBLE>) AS probabilities", "CAST(NULL AS DOUBLE) AS prediction").schema

    def score(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            codes = bins.codes([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in x])
            p = model.chances(model.raw(codes))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(list(p), pa.list_(pa.float64())), pa.array(p.argmax(1).astype(float))], schema.names)

    return wide.mapInArrow(score, schema)


def boosted_classifier(
    train: DataFrame, test: DataFrame, features: Sequence[str], classes: int, label: str = "label", weight: str | None = None,
    iterations: int = 100, setting: Setting = Setting(), bins: int = BINS,
) -> DataFrame:
    """``test`` scored by one model: two classes by a logistic loss, more by softmax with a tree a class."""
    cut = fit_bins(train, features, bins)
    model = Boosted("model", setting, classes)
    Boosting(binned(train, cut, label, weight), cut, [model]).fit(iterations)
    return predict(test, cut, model)


def halving_search(
    rows: DataFrame, bins: Bins, candidates: Sequence[Setting], folds: Sequence[int], schedule: Sequence[tuple[int, int]], classes: int = 2,
) -> list[dict]:
    """Successive halving over settings; the resource is the number of trees and grows along ``schedule``, (candidates,
    trees) per rung. All candidates and folds of a rung are boosted together; survivors keep their trees and go on.
    """
    models = {(i, f): Boosted(f"{i}|{f}", c, classes, f) for i, c in enumerate(candidates) for f in folds}
    job = Boosting(rows, bins, list(models.values()))
    alive, history, trees = list(range(len(candidates))), [], 0
    for rung, (n, resource) in enumerate(schedule):
        alive = alive[:n]
        now = [models[i, f] for i in alive for f in folds]
        job.fit(resource - trees, now)
        trees = resource
        report = report_averages(class_report(job.confusion(now), ["model"]), ["model"])
        marks = report.select(F.split("model", r"\|")[0].cast("int").alias("candidate"), "balanced_accuracy")
        scores = {r["candidate"]: r["score"] for r in marks.groupBy("candidate").agg(F.avg("balanced_accuracy").alias("score")).collect()}
        for i in alive:
            history.append({"rung": rung, "candidate": i, "resource": resource, "setting": candidates[i], "score": scores[i]})
        alive = sorted(alive, key=lambda i: (-scores[i], i))
    return history
