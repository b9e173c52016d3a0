"""Shards cut from a Hilbert curve over quantised metadata. DataFrame functions only.

Each row becomes a cell of a grid: `bits` bits for each dimension (language, source, size, id). Cells are quantiles of the table: a dimension is cut at the values below which equal
shares of the rows lie (from one aggregate over all rows; a value never spans cells). Language and source are placed by their first six bytes as a number, so the cells keep their order.
Rows are ordered by the cell's place on the Hilbert curve, then by id, and cut into runs of
equal row counts, so that a shard covers a compact box of the grid and readers skip shards by the ranges of each dimension.

Ranks come from one range shuffle of narrow rows: partitions are sorted, numbered in place and written to the shared folder; the
offsets of the partitions (a row for each partition) are added by a join. No text is shuffled.

The law is `rows`: it fixes the counts, so equal texts aren't kept together; they are rows of their own, placed by the curve like others.

Nulls: a null text has size 1 (0 bytes plus 1) and the CRC of no bytes; null dimensions count as the empty string or the least id. Ties and
repeated rows get places of their own, in no set order among equal ones. Texts of any length count by their size alone. Other columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.session import Stored

BITS = 4
SHARDS = 16


def curve_index(df: DataFrame, cells: list[str], bits: int, out: str) -> DataFrame:
    """Add the Hilbert index of the integer columns `cells`, each below 2**bits (after Skilling, AIP Conf. Proc. 707, 2004)."""
    n, top = len(cells), 1 << (bits - 1)
    steps = F.array(*[F.struct(F.lit(top >> level).alias("q"), F.lit(i).alias("i")) for level in range(bits - 1) for i in range(n)])

    def step(x: Column, s: Column) -> Column:
        low = s["q"] - F.lit(1)
        first, own = F.element_at(x, 1), F.element_at(x, s["i"] + 1)
        bit, swap = own.bitwiseAND(s["q"]) != 0, first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(x, lambda v, k: F.when(bit, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).when((k == 0) | (k == s["i"]), v.bitwiseXOR(swap)).otherwise(v))

    undone = F.aggregate(steps, F.array(*[F.col(c).cast("int") for c in cells]), step) if bits > 1 else F.array(*[F.col(c).cast("int") for c in cells])
    df = df.withColumn("__x", undone)
    gray, total = [], F.element_at("__x", 1)
    for i in range(n):
        total = total.bitwiseXOR(F.element_at("__x", i + 1)) if i else total
        gray.append(total)
    df = df.withColumn("__g", F.array(*gray))
    flip = F.lit(0)
    for level in range(bits - 1):
        q = top >> level
        flip = flip.bitwiseXOR(F.when(F.element_at("__g", n).bitwiseAND(q) != 0, q - 1).otherwise(0))
    df = df.withColumn("__t", flip)
    index = F.lit(0).cast("long")
    for level in range(bits):
        for i in range(n):
            bit = F.shiftright(F.element_at("__g", i + 1).bitwiseXOR(F.col("__t")), bits - 1 - level).bitwiseAND(1)
            index = index + F.shiftleft(bit.cast("long"), n * (bits - 1 - level) + n - 1 - i)
    return df.withColumn(out, index).drop("__x", "__g", "__t")


DIMENSIONS = ["d_lang", "d_source", "d_size", "d_id"]


def place_of(text: Column) -> Column:
    """The first six bytes of a string as a number that keeps their order; null is the empty string."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    return F.conv(F.rpad(F.hex(F.substring(raw, 1, 6)), 12, "0"), 16, 10).cast("double")


def cells(values: DataFrame, names: list[str], bits: int) -> DataFrame:
    """The numbers of the columns `names` as cells below 2**bits: in how many of the 2**bits - 1 quantile cuts they lie above."""
    side = 1 << bits
    shares = [k / side for k in range(1, side)]
    cuts = values.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in names]).first()
    above = lambda c: sum(((F.col(c) > F.lit(x)).cast("int") for x in cuts[c] or []), F.lit(0))
    return values.withColumns({c: above(c) for c in names})


def metadata_cells(docs: DataFrame, bits: int = BITS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the cells d_lang, d_source, d_size, d_id."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    # what the cuts are made of leaves the texts' checksums alone
    dimensions = {"d_lang": place_of(F.col("lang")), "d_source": place_of(F.col("source")), "d_size": size.cast("double"), "d_id": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double")}
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long")
    return cells(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), *[v.alias(k) for k, v in dimensions.items()]), DIMENSIONS, bits)


def ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with `rank`, its 0-based place in that order, and the number of rows."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())  # df has no such names: callers pack theirs
    stored = Stored(placed, "ranked").df.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = stored.groupBy("__part").agg(F.count("*").alias("__rows"))
    total = sizes.agg(F.sum("__rows")).first()[0] or 0
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the range shuffle, far below any broadcast limit
    offsets = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    out = stored.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__offset") + F.col("__row"))
    return out.drop("__part", "__row", "__offset", "__at"), total


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the cells with the curve index.

    The law is `rows`: counts differ by one at most. slot is the place in the shard, in curve order.
    """
    placed, total = ranked(curve_index(metadata_cells(docs, bits, text), DIMENSIONS, bits, "hilbert"), ["hilbert", "doc_id", "text_crc32", "size"])
    shard = F.expr(f"rank * {shards} div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    cut = placed.withColumn("shard", shard).withColumn("slot", F.col("rank") - start)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), *DIMENSIONS, "hilbert")


def shard_ranges(assigned: DataFrame) -> DataFrame:
    """For each shard its rows, bytes and the range of each dimension: what a reader prunes files by."""
    ranges = [f(c).alias(f"{n}_{c}") for c in (*DIMENSIONS, "doc_id") for n, f in (("min", F.min), ("max", F.max))]
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write docs as one folder a shard, rows in curve order; doc_id must be unique in docs. The cells stand beside the columns of docs under their names, which give way: readers prune by
    them, or by the columns they were made from."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id")
    placed = packed.join(assigned.select("doc_id", "shard", "slot", *DIMENSIONS), "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    added = ["shard", "slot", *DIMENSIONS]
    placed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added], *added).write.partitionBy("shard").parquet(path)
