"""Merkle manifest of a table: one tree of digests for each group, their roots joined by a tree of their own.

Trees have eight children a node. They are stored in blocks, aligned subtrees of four levels of runs (4,096 entries), each an
array of 32-byte digests in van Emde Boas order: a subtree is split at half its height, the upper part comes first, then the
lower parts one after the other, each laid out the same way. Addresses come from that arithmetic alone, for building and for
reading siblings. The roots of blocks are the entries of the next blocks, until one block is left.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.ranking import global_position
from panelkit.session import cut_lineage

from .columns import read

#: Children of a node, and levels of runs in a block.
ARITY, HEIGHT = 8, 4
#: Entries of a full block.
ENTRIES = ARITY**HEIGHT
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

BLOCK = "tree string, block long, n long, nodes binary, root string"
STEP = "array<struct<before: string, after: string>>"


def nodes_of(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


@lru_cache(maxsize=None)
def layout(levels: int) -> tuple[np.ndarray, ...]:
    """Addresses in van Emde Boas order: one array for each depth from the root, node by node."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    top = levels // 2
    upper, lower = layout(top), layout(levels - top)
    roots = nodes_of(top) + nodes_of(levels - top) * np.arange(ARITY**top)
    return (*upper, *((roots[:, None] + part[None, :]).ravel() for part in lower))


def levels_for(n: int, size: int = ENTRIES) -> int:
    """Levels of a block where a tree has ``n`` entries: as many as they need, those of a full block of ``size`` if there are more."""
    levels = 1
    while ARITY ** (levels - 1) < min(n, size):
        levels += 1
    return levels


def counts_of(entries: int, levels: int) -> list[int]:
    """Nodes in use at each depth."""
    out = [entries]
    for _ in range(levels - 1):
        out.append(-(-out[-1] // ARITY))
    return out[::-1]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def build_nodes(entries: list[str], levels: int) -> bytes:
    """A block in its layout, from the digests of its entries. The last run of a level may be shorter, even one node."""
    place, row = layout(levels), entries
    nodes = np.zeros((nodes_of(levels), 32), np.uint8)
    for depth in range(levels - 1, -1, -1):
        nodes[place[depth][: len(row)]] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        row = [digest("".join(row[k : k + ARITY])) for k in range(0, len(row), ARITY)]
    return nodes.tobytes()


def steps_of(nodes: bytes, entries: int, levels: int) -> list[list[dict]]:
    """For each entry, from its level up to the block's root: digests of the run to its left and to its right."""
    place, flat = layout(levels), np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    counts = counts_of(entries, levels)
    above: list[list[dict]] = [[]]
    for depth in range(1, levels):
        row = flat[place[depth][: counts[depth]]].tobytes().hex()
        here = []
        for k in range(counts[depth]):
            low = k - k % ARITY
            high = min(low + ARITY, counts[depth])
            here.append([{"before": row[64 * low : 64 * k], "after": row[64 * (k + 1) : 64 * high]}, *above[k // ARITY]])
        above = here
    return above


def fold(entry: str, steps: list[dict]) -> str:
    """The root that an entry gives with its siblings."""
    for step in steps:
        entry = digest(step["before"] + entry + step["after"])
    return entry


def _build(group: pa.Table, size: int) -> pa.Table:
    rows = group.sort_by("at")
    n, first = rows["n"][0].as_py(), rows["at"][0].as_py()
    nodes = build_nodes(rows["digest"].to_pylist(), levels_for(n, size))
    return pa.Table.from_pydict({
        "tree": [rows["tree"][0].as_py()], "block": [first // size], "n": [n], "nodes": [nodes], "root": [nodes[:32].hex()],
    }, pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("nodes", pa.binary()), ("root", pa.string())]))


@dataclass
class Forest:
    """Blocks of trees, the lowest first: ``tree, block, n, nodes, root`` with ``n`` the entries of the tree at that level.
    ``size`` is the entries of a full block."""

    levels: list[DataFrame]
    size: int = ENTRIES

    def roots(self) -> DataFrame:
        """``tree, root``."""
        done = [b.filter(F.col("n") <= self.size).select("tree", "root") for b in self.levels]
        out = done[0]
        for part in done[1:]:
            out = out.union(part)
        return out


def grow(entries: DataFrame, size: int = ENTRIES) -> Forest:
    """Trees from ``tree, at, n, digest``: entries counted from 0 in each tree of ``n``. A task builds a block at a time."""
    levels = []
    while True:
        grouped = entries.select("tree", "at", "n", "digest").groupBy("tree", F.floor(F.col("at") / size).alias("block"))
        levels.append(cut_lineage(grouped.applyInArrow(lambda group: _build(group, size), BLOCK), "merkle"))
        wide = levels[-1].filter(F.col("n") > size)
        if wide.isEmpty():
            return Forest(levels, size)
        entries = wide.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("digest"))


def place_rows(df: DataFrame, tree: str, rest: list[str]) -> DataFrame:
    """``at`` and ``n``: number of the row in its tree, from 0 in the order of ``rest``, and the tree's rows."""
    placed = cut_lineage(global_position(df, tree, rest, "at"), "places")
    sizes = cut_lineage(placed.groupBy(tree).agg((F.min("at")).alias("low"), F.count("*").alias("n")), "sizes")
    return placed.join(sizes, tree).withColumn("at", F.col("at") - F.col("low")).drop("low")


def block_paths(forest: Forest, tops: DataFrame) -> list[DataFrame]:
    """For each level of the forest ``tree, block, n, nodes, above``: the steps from the block's root to the end of ``tops``
    (``tree, above``), which holds those of whole trees. Goes down from the last blocks to the lowest."""
    schema, size = f"tree string, block long, above {STEP}", forest.size

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                entries = min(size, row["n"] - row["block"] * size)
                inside = steps_of(row["nodes"], entries, levels_for(row["n"], size))
                above = [{"before": s["before"], "after": s["after"]} for s in row["above"]]
                yield pa.RecordBatch.from_pylist(
                    [{"tree": row["tree"], "block": row["block"] * size + k, "above": steps + above} for k, steps in enumerate(inside)],
                    pa.schema([("tree", pa.string()), ("block", pa.int64()),
                               ("above", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))]))

    out, upper = [], None
    for blocks in reversed(forest.levels):
        found = blocks.filter(F.col("n") <= size).join(tops, "tree").select("tree", "block", "n", "nodes", "above")
        if upper is not None:
            below = blocks.filter(F.col("n") > size).join(upper, ["tree", "block"])
            found = found.union(below.select("tree", "block", "n", "nodes", "above"))
        found = cut_lineage(found, "paths")
        out.append(found)
        upper = found.mapInArrow(spread, schema)
    return out[::-1]


def entry_paths(entries: DataFrame, blocks: DataFrame, size: int, out: str, rows) -> DataFrame:
    """``rows(entry, steps)`` for each entry (``tree, at`` and more) with the steps from it to the end of its path."""
    names = [f.strip().split()[0] for f in out.split(",")]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        block = right.to_pylist()[0] if right.num_rows else None
        found = []
        if block is not None:
            first = block["block"] * size
            inside = steps_of(block["nodes"], min(size, block["n"] - first), levels_for(block["n"], size))
            found = [rows(entry, inside[entry["at"] - first] + block["above"]) for entry in left.to_pylist()]
        types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        schema = pa.schema([(f.strip().split()[0], types[f.strip().split()[1]]) for f in out.split(",")])
        return pa.Table.from_pydict({name: [r[k] for r in found] for k, name in enumerate(names)}, schema)

    key = F.floor(F.col("at") / size).alias("block")
    return entries.groupBy("tree", key).cogroup(blocks.groupBy("tree", "block")).applyInArrow(join, out)


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a row: each value as its bytes' count, a colon and the value; ``-`` for null."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(v) for v in fields.values()]), 256)


def tree_key(column: Column) -> Column:
    """A string that sorts null first and other values by their bytes, and tells null from any value."""
    return F.coalesce(F.concat(F.lit("="), column), F.lit(""))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """``tree, doc_id, digest, altered``: a row's leaf, and that of the row with A-Z lowered in its text where ``tampered``."""
    lowered = F.when(tampered, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    whole = {c: F.col(c) for c in FIELDS}
    return docs.select(tree_key(F.col("lang")).alias("tree"), "doc_id", leaf(whole).alias("digest"), leaf({**whole, "text": lowered}).alias("altered"))


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, tampered: Column | None = None, size: int = ENTRIES) -> tuple[Forest, Forest, DataFrame, DataFrame]:
    """The forest of the groups (``lang``), the tree over their roots (``tree`` is empty), its entries and the placed leaves.

    Every row is a leaf. Within a group leaves ascend by ``doc_id``, null first, equal ids by their leaf; rows equal in all
    columns of a leaf are leaves of their own. Null values and empty texts have leaves that differ. An empty table has no
    root. Columns other than those of a leaf are not read. The last step's group is as large as a block at most.
    """
    rows = leaves(docs, F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False)))
    placed = cut_lineage(place_rows(rows, "tree", ["doc_id", "digest", "altered"]), "leaves")
    forest = grow(placed, size)
    ordered = global_position(forest.roots(), "tree", name="at").withColumn("at", F.col("at") - 1)
    tops = ordered.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "at", F.lit(ordered.count()).cast("long").alias("n"), F.col("root").alias("digest"))
    tops = cut_lineage(tops, "groups")
    return forest, grow(tops, size), tops, placed


def proofs(docs: DataFrame, tampered: Column | None = None, size: int = ENTRIES) -> DataFrame:
    """For each row: its leaf, its group's root, the root, the digest of its proof (siblings from the leaf's run up to the
    root), the root recomputed from its leaf as it stands after ``tampered``, and whether both roots are equal."""
    forest, over, groups, placed = manifest(docs, tampered, size)
    root = over.roots().first()
    if root is None:
        return docs.sparkSession.createDataFrame([], PROOF)
    root = root["root"]
    none = F.from_json(F.lit("[]"), STEP)
    upper = block_paths(over, over.roots().select("tree", none.alias("above")))[0]

    def joined(entry, steps):
        return entry["group"], entry["digest"], "".join(s["before"] + "," + s["after"] + ";" for s in steps)

    tops = entry_paths(groups, upper, size, "group string, digest string, steps string", joined)
    step = F.transform(
        F.filter(F.split("steps", ";"), lambda s: s != ""),
        lambda s: F.struct(F.split_part(s, F.lit(","), F.lit(1)).alias("before"), F.split_part(s, F.lit(","), F.lit(2)).alias("after")))
    tops = cut_lineage(tops.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), step.alias("above")), "tops")
    lowest = block_paths(forest, tops.select("tree", "above"))[0]

    def proven(entry, steps):
        altered = fold(entry["altered"], steps)
        path = "".join(s["before"] + s["after"] for s in steps)
        return entry["tree"], entry["doc_id"], entry["digest"], digest(path), altered

    found = entry_paths(placed, lowest, size, "tree string, doc_id long, leaf string, proof_sha256 string, folded_root string", proven)
    return found.join(tops.select("tree", "subroot"), "tree").select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def every_third() -> Column:
    """Rows whose id, as decimal text, has a checksum that three divides."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return proofs(read(spark, sf_dir, "documents"), every_third())
