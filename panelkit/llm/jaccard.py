"""N-gram Jaccard join: prefixes, groups of equal prefixes, verified links, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.session import cut_lineage, drop_frames

from .columns import free_name, read
from .components import stars
from .sketches import HELD, PART, Parts, share
from .textarrays import Block, blocks, mix
from .workers import short_batches, tidy

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE = 4
LEAST = 85
#: Shingles that stand last in the order of prefixes: the most frequent, this many at most. Any order gives the
#: same links; this one keeps the lists of shingles short.
FREQUENT = 1 << 17
#: A shingle is a candidate for that list once a task holds it in so many texts at a time.
NOTED = 8
#: Cells of the filters of shingles and of ids, as powers of two: 32 MB and 8 MB at most.
LOG_TOKENS, LOG_IDS = 28, 26
#: Least words of 64 bits in a set's parity bits. Larger sets have a power of two of them, as many bits as shingles at least.
PARITY = 16
#: Words of them that go with each row of a list, where rows are many; the pairs found are held against all bits.
LISTED = 8
#: Pairs of texts compared at a time.
VERIFIED = 64
#: Star rounds before the remaining pairs are all tried.
ROUNDS = 3


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct shingle, sorted by text. Fewer words than ``size`` are one shingle."""
    words, first = block.word_hash(), block.first_word()
    at, hashes = block.window_hash(words, size)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    doc = np.concatenate([block.doc[at], short])
    hashes = np.concatenate([hashes, block.span_hash(words, first[short], first[short + 1])])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[head], hashes[head]


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the FREQUENT most counted shingles, and their places from rare to frequent."""

    @tidy
    def note(batches):
        held, n = [], 0

        def flush():
            hashes, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= NOTED
            return pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(count[often])], ["token", "n"])

        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                held.append(shingle_sets(block, size)[1])
                n += len(held[-1])
                if n >= HELD:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    noted = docs.select("text").mapInArrow(note, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = noted.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()  # a fixed number of rows
    hashes = rows["token"].to_numpy(np.int64).view(np.uint64)
    place = np.arange(len(hashes), 0, -1)
    order = np.argsort(hashes)
    return hashes[order], place[order]


def signatures(docs: DataFrame, size: int, least: int, frequent) -> DataFrame:
    """``doc_id, n`` (set size), ``a, b`` (128 bits of the set), ``same`` (prefix and size), ``prefix``: the shingles of
    which similar sets share at least one, in order, and ``parity``: bits that each shingle of the set flips one of.
    Texts without words have n = 0 and no prefix."""
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
        T.StructField("same", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType())),
    ])

    @tidy
    def sign(batches):
        known, place = frequent.value
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                doc, hashes = shingle_sets(block, size)
                n = np.bincount(doc, minlength=block.texts)
                first = np.concatenate([[0], np.cumsum(n)])
                rank = np.zeros(len(hashes), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    rank = np.where(known[at] == hashes, place[at], 0)
                order = np.lexsort((hashes, rank, doc))
                doc, hashes = doc[order], hashes[order]
                length = np.where(n > 0, n - (least * n + 99) // 100 + 1, 0)
                inside = np.arange(len(doc)) - first[doc] < length[doc]
                full = np.flatnonzero(n)

                def total(values, salt, full=full):
                    out = np.zeros(block.texts, np.uint64)  # noqa: B023
                    out[full] = np.add.reduceat(mix(values + mix(np.array([salt], np.uint64))), first[full]) if len(full) else 0  # noqa: B023
                    return mix(out).view(np.int64)

                a, b = total(hashes, 1), total(hashes, 2)
                prefix = np.where(inside, hashes, np.uint64(0))
                same = mix(total(prefix, 3).view(np.uint64) + n.astype(np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(hashes[inside].view(np.int64)))
                flips = mix(hashes + mix(np.array([4], np.uint64)))
                width = PARITY << np.ceil(np.log2(np.maximum(n / (64 * PARITY), 1))).astype(np.int64)
                start = np.concatenate([[0], np.cumsum(width)])
                parity = np.zeros(start[-1], np.uint64)
                word = (flips & (width[doc] - 1).astype(np.uint64)).astype(np.int64)
                np.bitwise_xor.at(parity, start[doc] + word, np.uint64(1) << (flips >> np.uint64(58)))
                parities = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(parity.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, block.texts), pa.array(n), pa.array(a), pa.array(b), pa.array(same), lists, parities],
                    schema.names,
                )

    return docs.select("doc_id", "text").mapInArrow(sign, schema)


def may_hold(df: DataFrame, column: str, bits) -> DataFrame:
    """Rows whose ``column`` (long, last in no way) a shared bitmap may hold."""
    at, names = df.columns.index(column), df.columns

    @tidy
    def keep(batches):
        for batch in batches:
            values = batch.column(at).cast(pa.int64())
            key = mix(values.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            flag = bits.value.may_hold(key, key) & ~values.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(flag)).columns, names)

    return df.mapInArrow(keep, df.schema)


def bitmap(df: DataFrame, column: str, log_cells: int, which: str = "seen"):
    """Shared bitmap of the values of a long column."""

    @tidy
    def sketch(batches):
        parts = Parts(1, log_cells)
        for batch in batches:
            key = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield from parts.add(key, key)
        yield from parts.flush()

    return share(df.select(F.col(column).cast("long")).filter(F.col(column).isNotNull()).mapInArrow(sketch, PART), 1, log_cells, which)


def verified(docs: DataFrame, pairs: DataFrame, size: int, least: int) -> DataFrame:
    """Rows of ``pairs``, pairs ``x, y`` of ids with their components ``u, v``, whose texts' shingle sets are similar. Only
    texts of these ids are shuffled."""
    bits = bitmap(pairs.select("x").union(pairs.select("y")), "x", LOG_IDS)
    texts = may_hold(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", bits)
    left, right = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "xy")

    def sets_of(column):
        rows, hashes = [], []
        for block in blocks(column, lower=True):
            doc, h = shingle_sets(block, size)
            rows.append(doc + block.first)
            hashes.append(h)
        return np.concatenate(rows), np.concatenate(hashes)

    @tidy
    def similar(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, VERIFIED):
                batch = whole.slice(at, VERIFIED)
                (row_x, x), (row_y, y) = sets_of(batch.column("text_x")), sets_of(batch.column("text_y"))
                row, hashes = np.concatenate([row_x, row_y]), np.concatenate([x, y])
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                again = np.flatnonzero((row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1]))
                both = np.bincount(row[again], minlength=batch.num_rows)
                either = np.bincount(row, minlength=batch.num_rows) - both
                ok = pa.array((100 * both >= least * either) & (both > 0))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in "xyuv"], [*"xyuv"])

    met = pairs.join(left, "x").join(right, "y").select("x", "y", "u", "v", "text_x", "text_y")
    return met.mapInArrow(similar, "x long, y long, u long, v long")


def _possible(least: int, one: str, other: str) -> str:
    """What similar sets' sizes fulfil, and the room left behind a shared shingle at the given places of both."""
    n, m, i, j = f"{one}.n", f"{other}.n", f"{one}.place", f"{other}.place"
    room = f"least({n} - {i}, {m} - {j})"
    return f"100 * least({n}, {m}) >= {least} * greatest({n}, {m}) and {room} * {100 + least} >= {least} * ({n} + {m})"


def near_duplicates(docs: DataFrame, size: int = SHINGLE, least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row for each row: the smallest id that links reach.

    Two documents link if their sets of lower-cased word shingles have a Jaccard similarity of ``least`` hundredths.
    Rows with one id are one node with the links of all of them. A text without words links with nothing; a null id
    has a null component.

    1. Equal sets collapse to their smallest id (mergeable), equal prefixes and sizes to groups.
    2. Groups are listed under the shingles of their prefix; a bitmap of shingles seen twice drops the others before
       the shuffle. A group of several sets is a list of its own, of its members.
    3. Star rounds: in each list that holds several components, one drawn group meets the groups of other components.
       Pairs of groups that pass the size and place filters are expanded to their members, pairs of members that pass the
       parity filter are verified. Links join components, so large groups of near copies shrink to one without trying
       all pairs.
    4. What is left: all pairs of groups of different components that pass the filters are expanded and verified. Only
       groups outside a list's largest component look for partners in it.
    """
    spark = docs.sparkSession
    short_batches(spark)
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, size))
    signed = cut_lineage(signatures(docs, size, least, frequent), "signed")
    node = F.col("doc_id").cast("long")
    some = signed.filter("n > 0 and doc_id is not null")
    sets = some.groupBy("a", "b", "n").agg(F.min(node).alias("rep"), F.min("same").alias("same"))
    sets = cut_lineage(sets, "sets")
    tokens = some.select("same", "n", F.posexplode("prefix").alias("place", "token"))
    again = bitmap(tokens, "token", LOG_TOKENS, "again")
    tokens = may_hold(tokens.select("token", "place", "same", "n"), "token", again).distinct()
    groups = sets.groupBy("same", "n").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("rep"))
    crowd = groups.filter("k > 1").select(F.col("same").alias("crowd"), "n")
    members = sets.select(F.col("same").alias("crowd"), "n", "rep", F.col("rep").alias("component"))
    members = cut_lineage(members.join(crowd, ["crowd", "n"], "left_semi"), "members")
    lists = tokens.join(groups, ["same", "n"]).select(
        "token", "place", "n", "rep", F.expr("if(k = 1, rep, null)").alias("component"), F.expr("if(k > 1, same, null)").alias("crowd"))
    own = members.select(F.col("crowd").alias("token"), F.lit(0).alias("place"), "n", "rep", "component", F.lit(None).cast("long").alias("crowd"))
    written = lists = cut_lineage(lists.unionByName(own), "lists")
    nodes = cut_lineage(sets.select(F.col("rep").alias("node"), F.col("rep").alias("component")).distinct(), "nodes")
    for turn in range(rounds + 1):
        before, lists = written, _open_lists(lists)
        written = lists
        drop_frames(before)
        if turn < rounds:
            pairs = _expanded(_star_pairs(lists, least, turn), members, turn)
        else:
            written = _with_parity(lists, some)
            drop_frames(lists)
            pairs = _expanded(_remaining_pairs(written, least), members)
        pairs = cut_lineage(pairs.distinct(), "pairs")
        if turn == rounds:
            drop_frames(written)
        merged = None
        if not pairs.isEmpty():
            near = _near(pairs, some, least)
            drop_frames(pairs)
            merged = _merged(verified(docs, near, size, least))
        if merged is not None and turn < rounds:
            members = cut_lineage(_moved(members, merged), "members")
            # each state of the lists replaces the one before
            lists = cut_lineage(_moved_lists(lists, members, merged), "lists")
            drop_frames(written)
            written = lists
        if merged is not None:
            nodes = cut_lineage(_moved(nodes, merged), "nodes")

    reps = sets.select("a", "b", "n", "rep")
    placed = signed.select("doc_id", "n", "a", "b").join(reps, ["a", "b", "n"], "left")
    placed = placed.join(nodes.withColumnRenamed("node", "rep"), "rep", "left")
    # rows with one id share their component
    least_of = placed.filter("doc_id is not null and component is not null").groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(least_of, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce(F.col("component_id"), F.col("doc_id").cast("long")).alias("component_id"))


def _open_lists(lists: DataFrame) -> DataFrame:
    """Rows of the lists that still hold several components; a group without one has members of several."""
    n, known = F.count(F.lit(1)), F.count("component")
    held = lists.groupBy("token").agg(((F.min("component") < F.max("component")) | ((known < n) & (n > 1))).alias("open")).filter("open")
    return cut_lineage(lists.join(held.select("token"), "token", "left_semi"), "lists")


_PAIR = [f"{side}.{c} AS {side}_{c}" for side in "ab" for c in ("rep", "n", "component", "crowd")]


def _star_pairs(lists: DataFrame, least: int, turn: int) -> DataFrame:
    """In each list, all groups of other components that pass the filters (a) with the group of a draw (b)."""
    draw = F.xxhash64("rep", F.lit(turn))
    center = lists.groupBy("token").agg(F.min(F.struct(draw.alias("draw"), "rep", "n", "place", "component", "crowd")).alias("b"))
    star = lists.alias("a").join(center, "token").filter("a.rep <> b.rep and coalesce(a.component <> b.component, true)")
    return star.filter(_possible(least, "a", "b")).selectExpr(*_PAIR).distinct()


def _expanded(pairs: DataFrame, members: DataFrame, turn: int | None = None) -> DataFrame:
    """Pairs of groups -> pairs ``x, y`` of members of different components ``u, v``: each member of one with each of the
    other, or, with ``turn``, with a drawn one."""
    drawn = members
    if turn is not None:
        draw = F.xxhash64("rep", F.lit(turn))
        drawn = members.groupBy("crowd", "n").agg(F.min_by(F.struct("rep", "component"), draw).alias("m")).select("crowd", "n", "m.*")
    out = pairs
    for side, held in (("b", drawn), ("a", members)):
        held = held.select(F.col("crowd").alias("key"), F.col("n").alias(f"{side}_n"), F.col("rep").alias("held_rep"), F.col("component").alias("held_component"))
        # groups of one set meet no member; their rows are spread by a hash and not all under null
        spread = out.withColumn("key", F.coalesce(f"{side}_crowd", F.xxhash64("a_rep", "b_rep"))).alias("p")
        held = held.alias("h")
        same = (F.col("p.key") == F.col("h.key")) & (F.col(f"p.{side}_n") == F.col(f"h.{side}_n")) & F.col(f"p.{side}_crowd").isNotNull()
        met = spread.join(held, same, "left").filter(F.col(f"p.{side}_crowd").isNull() | F.col("held_rep").isNotNull())
        own = {f"{side}_{c}": F.when(F.col(f"p.{side}_crowd").isNotNull(), F.col(f"held_{c}")).otherwise(F.col(f"p.{side}_{c}")) for c in ("rep", "component")}
        out = met.select(*[own.get(c, F.col(f"p.{c}")).alias(c) for c in out.columns])
    met = out.filter("a_rep <> b_rep and a_component <> b_component")
    low, high = ([F.when(F.expr("a_rep < b_rep"), F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")) for c in ("rep", "component")] for p, q in ("ab", "ba"))
    return met.select(low[0].alias("x"), high[0].alias("y"), low[1].alias("u"), high[1].alias("v"))


def _folded(bits: str, words: str) -> str:
    """Parity bits as they are in that many words: a power of two, and no more than there are."""
    folded = f"transform(sequence(0, {words} - 1), i -> aggregate(sequence(i, size({bits}) - 1, {words}), 0L, (s, k) -> s ^ {bits}[k]))"
    return f"if(size({bits}) = {words}, {bits}, {folded})"


def _near(pairs: DataFrame, signed: DataFrame, least: int) -> DataFrame:
    """Pairs of ids whose sets may be similar by all their parity bits. Ids with several sets pass."""
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    known = signed.select(F.col("doc_id").cast("long").alias("id"), "n", "a", "parity").join(ids, "id", "left_semi")
    one = F.when((F.min("a") == F.max("a")) & (F.min("n") == F.max("n")), F.min("parity")).alias("p")
    bits = cut_lineage(known.groupBy("id").agg(F.min("n").alias("n"), one), "parity")
    met = pairs
    for k in "xy":
        met = met.join(bits.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("p").alias(f"p{k}")), k)
    words = "least(size(px), size(py))"
    odd = f"aggregate(zip_with({_folded('px', words)}, {_folded('py', words)}, (u, v) -> bit_count(u ^ v)), 0, (s, c) -> s + c)"
    # each shingle that only one of two sets has flips one bit: sets differ in as many shingles at least as in bits
    near = met.filter(f"px is null or py is null or ({odd}) * {100 + least} <= {100 - least} * (nx + ny)")
    near = cut_lineage(near.select("x", "y", "u", "v"), "near")
    drop_frames(bits)
    return near


def _with_parity(lists: DataFrame, signed: DataFrame) -> DataFrame:
    """Lists with LISTED words of parity bits of single sets; null for groups of several, and for an id's several sets of
    one size."""
    reps = lists.select("rep").distinct()
    known = signed.select(F.col("doc_id").cast("long").alias("rep"), "n", "a", "parity").join(reps, "rep", "left_semi")
    known = known.withColumn("parity", F.expr(_folded("parity", str(LISTED))))
    one = F.when(F.min("a") == F.max("a"), F.min("parity")).alias("parity")
    placed = lists.join(known.groupBy("rep", "n").agg(one), ["rep", "n"], "left")
    return cut_lineage(placed.withColumn("parity", F.expr("if(crowd is null, parity, null)")), "lists")


def _remaining_pairs(lists: DataFrame, least: int) -> DataFrame:
    """All pairs of groups of different components that share a list and pass the filters. The groups of a list's
    largest component look for no partners; they are found by the others. Pairs that differ in more parity bits than
    similar sets can are dropped where they meet."""
    sizes = lists.filter("component is not null").groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("token").agg(F.max(F.struct("k", "component")).alias("m")).select("token", F.col("m.component").alias("main"))
    few = lists.join(main, "token", "left").filter("coalesce(component <> main, true)").alias("a")
    differ = "a.token = b.token and coalesce(a.component <> b.component, true) and (coalesce(b.component = a.main, false) or a.rep < b.rep) and "
    bits = " + ".join(f"bit_count(a.parity[{k}] ^ b.parity[{k}])" for k in range(LISTED))
    near = f" and coalesce(({bits}) * {100 + least} <= {100 - least} * (a.n + b.n), true)"
    return few.join(lists.alias("b"), F.expr(differ + _possible(least, "a", "b") + near)).selectExpr(*_PAIR).distinct()


def _merged(links: DataFrame) -> DataFrame | None:
    """``component, lower`` of the components ``u, v`` that links join to lower ones; None without links."""
    found = stars(links.select("u", "v"))
    return None if found.isEmpty() else found.select(F.col("u").alias("component"), F.col("v").alias("lower"))


def _moved(rows: DataFrame, merged: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c != "component"]
    return rows.join(merged, "component", "left").select(*others, F.coalesce("lower", "component").alias("component"))


def _moved_lists(lists: DataFrame, members: DataFrame, merged: DataFrame) -> DataFrame:
    """Lists after a merge; a group of several sets has a component once all its members share it."""
    one = _moved(lists.filter("crowd is null"), merged)
    low, high = F.min("component"), F.max("component")
    now = members.groupBy("crowd", "n").agg(F.when(low == high, low).alias("component"))
    several = lists.filter("crowd is not null").drop("component").join(now, ["crowd", "n"], "left")
    return one.unionByName(several)


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, one for each component: that of the smallest id. Rows with one id count once; rows without
    an id, and one for each id without words, stay."""
    found = near_duplicates(docs.select("doc_id", "text"), **options)
    ids = found.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.count(F.lit(1)).alias("k"), F.min("component_id").alias("component_id"))
    touched = cut_lineage(ids.filter("k > 1 or id <> component_id").select("id", (F.col("id") == F.col("component_id")).alias("stays")), "touched")
    bits = bitmap(touched, "id", LOG_IDS)
    flag = free_name(docs, "may_go")
    schema = T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())])
    at = docs.columns.index("doc_id")

    @tidy
    def mark(batches):
        for batch in batches:
            values = batch.column(at).cast(pa.int64())
            key = mix(values.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            may = bits.value.may_hold(key, key) & ~values.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may)], schema.names)

    marked = docs.mapInArrow(mark, schema)
    looked = marked.filter(F.col(flag)).join(touched, F.col("doc_id").cast("long") == touched["id"], "left")
    stay = looked.filter("id is null").unionByName(looked.filter("stays").dropDuplicates(["id"]))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return marked.filter(~F.col(flag)).select(*names).union(stay.select(*names))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
