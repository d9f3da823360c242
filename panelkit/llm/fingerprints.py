"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import cut_lineage

from .columns import read, text_of

#: Units of a gram, and grams of a window: a shared run of GRAM + WINDOW - 1 units always shares a fingerprint.
GRAM = 3
WINDOW = 8
#: A unit is a word, or any run of that many code points in a longer one: one starts at each of its code points.
UNIT = 16

_POSITIONS = (1 << 31) - 1


def units(text: Column, unit: int = UNIT) -> Column:
    """Words of up to ``unit`` code points; of a longer one the pieces of ``unit`` code points at every position, so that
    they do not depend on where it starts."""
    inside = r"[^\x20\x09-\x0D]"
    word = rf"(?<!{inside}){inside}{{1,{unit}}}+(?!{inside})"
    return F.regexp_extract_all(text, F.lit(rf"(?=({word}|{inside}{{{unit}}}))(?:{word}|{inside})"), F.lit(1))


def winnowed(text: Column, gram: int = GRAM, window: int = WINDOW, unit: int = UNIT) -> Column:
    """Picked grams of a text, as array<bigint>: 32 bits of hash above 31 bits of ``2**31 - 1 - position``.

    The smallest number of a window is thus its smallest hash, the rightmost on ties. A text shorter than a gram
    is one gram, a text with fewer grams than a window one window. No units or null: an empty array.
    """

    def pack(value: Column, position: Column) -> Column:
        low = F.shiftright(value, 7).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(low, 31).bitwiseOR(F.lit(_POSITIONS) - position.cast("bigint"))

    def grams(hashes: Column) -> Column:
        short = F.array(pack(F.xxhash64(hashes), F.lit(0)))
        starts = F.sequence(F.lit(0), F.size(hashes) - gram)
        many = F.transform(starts, lambda i: pack(F.xxhash64(*[hashes[i + j] for j in range(gram)]), i))
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).when(F.size(hashes) < gram, short).otherwise(many)

    def picks(packed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(packed) - window + 1)
        many = F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(packed, i, window))))
        one = F.array(F.array_min(packed))
        return F.when(F.size(packed) == 0, packed).when(F.size(packed) <= window, one).otherwise(many)

    hashes = F.transform(units(F.coalesce(text, F.lit("")), unit), lambda u: F.xxhash64(u))
    return _with(_with(hashes, grams), picks)


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hashes_of(picked: Column) -> Column:
    """The hashes alone, each once."""
    return F.array_distinct(F.transform(picked, lambda x: (F.shiftright(x, 31) - F.lit(1 << 31)).cast("int")))


def positions_of(picked: Column) -> Column:
    return F.transform(picked, lambda x: (F.lit(_POSITIONS) - x.bitwiseAND(F.lit(_POSITIONS))).cast("int"))


def as_text(picked: Column) -> Column:
    """``hash@position`` in hex, separated by spaces."""
    return F.array_join(F.transform(picked, lambda x: F.concat(
        F.hex(F.shiftright(x, 31)), F.lit("@"), F.hex(F.lit(_POSITIONS) - x.bitwiseAND(F.lit(_POSITIONS)))
    )), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two hash arrays; two empty ones are alike, an empty and a filled one not."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_neighbours(rows: DataFrame, key: list[str], carry: str, tasks: int) -> DataFrame:
    """``key, carry`` of unique rows (no nulls) -> with ``prev_<key>, prev_<carry>`` of the row before in key order, the last
    one's before the first. Range partitions are numbered and ordered apart; only their ends meet in one task."""
    ranged = rows.repartitionByRange(tasks, *key).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged, "ranged")
    whole = F.struct(*key, carry)
    inside = ranged.withColumn("before", F.lag(whole).over(Window.partitionBy("part").orderBy(*key)))
    ends = ranged.groupBy("part").agg(F.max(whole).alias("last"))
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.withColumn("ahead", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.last("last").over(everything)))
    joined = inside.join(ends.select("part", "ahead"), "part").withColumn("before", F.coalesce("before", "ahead"))
    return joined.select(*key, carry, *[F.col(f"before.{k}").alias(f"prev_{k}") for k in [*key, carry]])


def neighbour_edits(docs: DataFrame, **options) -> DataFrame:
    """Winnowed fingerprints of each text and of the same text with its second half replaced by the start of the
    next document's, with likenesses.

    Rows equal in doc_id and text count once, rows with one doc_id stand in the order of a hash of their text; a
    null doc_id comes first, a null text is empty. One shuffle of the texts by id, one of the heads of texts to
    the document before.
    """
    # plain keys without nulls, all of them used on every side: one shuffle by key serves all joins
    present, place = F.col("doc_id").isNotNull().alias("present"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("place")
    key = ["present", "place", "tie"]
    rows = docs.select(present, place, F.xxhash64(text_of()).alias("tie"), text_of().alias("text")).dropDuplicates(key)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = docs.select(present, place, F.xxhash64(text_of()).alias("tie"), F.char_length(text_of()).alias("n")).distinct()
    links = with_neighbours(links, key, "n", tasks)
    linked = rows.join(links, key)
    heads = linked.select(
        *[F.col(f"prev_{k}").alias(k) for k in key],
        F.expr("left(text, int(prev_n div 2))").alias("head"), hashes_of(winnowed(F.col("text"), **options)).alias("next_hashes"),
    )
    met = rows.join(heads, key).withColumn("doc_id", F.when(F.col("present"), F.col("place")).cast(docs.schema["doc_id"].dataType))
    n = F.char_length("text")
    edited = F.concat(F.left("text", (n - F.floor(n / 2)).cast("int")), F.col("head"))
    made = met.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), winnowed(F.col("text"), **options).alias("own"), "next_hashes")
    made = made.withColumn("changed", winnowed(F.col("edited"), **options))
    made = made.withColumn("own_hashes", hashes_of(F.col("own")))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), hashes_of(F.col("changed"))).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )


def fingerprint(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``fingerprint`` (hashes) and ``fingerprint_at`` (unit positions) of each text."""
    picked = docs.withColumn("_picked", winnowed(F.col("text"), **options))
    return picked.withColumn("fingerprint", F.transform("_picked", lambda x: F.shiftright(x, 31))).withColumn(
        "fingerprint_at", positions_of(F.col("_picked"))).drop("_picked")


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbour_edits(read(spark, sf_dir, "documents"))
