"""Sharding along a Hilbert curve over metadata dimensions, by DataFrame functions only.

Dimensions are quantised to a few bits each; the curve visits all cells so that
neighbours stay together, and runs of the curve become shards. Each shard then spans a
small box of the dimensions, so readers can skip shards (and row groups) by statistics of
any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Position on the curve of integer cells 0 .. 2**bits - 1 in each dimension.

    Skilling's transposed form: for every bit from the top, a dimension with that bit set
    inverts the lower bits of the first one, and one without it swaps them; then a Gray
    code over the dimensions, and the bits are read in turn.
    """
    n = len(cells)
    x = F.array(*[c.cast("long") for c in cells])
    places = F.array(*[F.lit(k) for k in range(n)])

    def at(a: Column, k) -> Column:
        return F.element_at(a, k + 1)

    def has(v: Column, q: Column) -> Column:
        return v.bitwiseAND(q) != 0

    def one(a: Column, i: Column, q: Column) -> Column:
        p = q - 1
        swap = at(a, F.lit(0)).bitwiseXOR(at(a, i)).bitwiseAND(p)
        first = F.when(has(at(a, i), q), at(a, F.lit(0)).bitwiseXOR(p)).otherwise(at(a, F.lit(0)).bitwiseXOR(swap))
        other = F.when(has(at(a, i), q), at(a, i)).otherwise(at(a, i).bitwiseXOR(swap))
        return F.transform(a, lambda v, k: F.when(k == 0, first).when(k == i, other).otherwise(v))

    tops = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<long>")
    x = F.aggregate(tops, x, lambda a, q: F.aggregate(places, a, lambda c, i: one(c, i, q)))
    # Gray code: each dimension takes the exclusive or of all before it
    x = F.aggregate(places, F.array().cast("array<long>"), lambda a, i: F.concat(a, F.array(F.when(i == 0, at(x, F.lit(0))).otherwise(F.coalesce(F.try_element_at(a, i), F.lit(0)).bitwiseXOR(at(x, i))))))
    last = F.transform(F.array(x), lambda a: F.struct(a.alias("a"), F.aggregate(tops, F.lit(0).cast("long"), lambda t, q: F.when(has(at(a, F.lit(n - 1)), q), t.bitwiseXOR(q - 1)).otherwise(t)).alias("t")))
    x = F.flatten(F.transform(last, lambda s: F.transform(s["a"], lambda v: v.bitwiseXOR(s["t"]))))
    all_bits = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])

    def bit(v: Column, b: Column) -> Column:
        return F.call_function("shiftright", v, b).bitwiseAND(F.lit(1).cast("long"))

    return F.flatten(F.transform(F.array(x), lambda a: F.array(F.aggregate(all_bits, F.lit(0).cast("long"), lambda h, b: F.aggregate(a, h, lambda g, v: g * 2 + bit(v, b))))))[0]


def quantised(column: str, kind: str, bits: int) -> Column:
    """A cell 0 .. 2**bits - 1. ``kind`` "name": by hash, equal names together; "size": by
    the logarithm, in half powers of two; null: 0."""
    top = (1 << bits) - 1
    if kind == "name":
        return F.coalesce(F.pmod(F.xxhash64(column), F.lit(1 << bits)), F.lit(0))
    return F.least(F.lit(top), F.greatest(F.lit(0), F.floor(2 * F.log2(F.coalesce(F.col(column).cast("double"), F.lit(0.0)) + 1)))).cast("long")


def shard(docs: DataFrame, shards: int = 8, law: str = "rows", dimensions: tuple[tuple[str, str], ...] = (("lang", "name"), ("source", "name"), ("size", "size")), bits: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot of every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1. Law "rows": shards are
    runs of the curve whose counts differ by one at most; "bytes": runs cut at equal
    shares of the bytes. Equal texts lie next to each other, in the cell of the least
    metadata among them; a group of them falls in two shards only where a cut that the
    law demands runs through it. A slot is the place in the shard, gapless from 0. Null
    metadata falls in cell 0, rows that repeat are kept, and an empty table gives none.
    The rows are sorted by ranges, counted per range, and only one count per range meets
    in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [c for c, kind in dimensions if c != "size"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text"), F.struct(*names).alias("_own"))
    rows = common.stored(rows, "rows")
    # most texts stand alone or with the same metadata: only the others are joined
    mixed = rows.groupBy("_text", "size", "text_crc32").agg(F.min("_own").alias("_first"), F.max("_own").alias("_last")).filter(~F.col("_first").eqNullSafe(F.col("_last"))).drop("_last")
    rows = rows.join(mixed, ["_text", "size", "text_crc32"], "left").withColumn("_own", F.coalesce("_first", "_own"))
    rows = rows.select("doc_id", "size", "text_crc32", "_text", "_own.*")
    curve = hilbert_index([quantised(c, kind, bits) for c, kind in dimensions], bits)
    rows = common.stored(rows.select("doc_id", "size", "text_crc32", "_text", curve.alias("curve")), "curve")
    order = ("curve", "_text", "text_crc32", "doc_id")
    ordered = rows.repartitionByRange(common.parts_for(docs.sparkSession), *order).sortWithinPartitions(*order)
    placed = common.stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, place = F.call_function("shiftright", F.col("_at"), F.lit(33)), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part).withColumn("_place", place)
    per_part = placed.groupBy("_part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_part.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.sum("n").over(everything).alias("total"), F.sum("bytes").over(everything).alias("total_bytes"))
    found = placed.join(F.broadcast(offsets), "_part")  # one row per range of the sort
    rank = F.col("n0") + F.col("_place")
    if law == "rows":
        found = found.withColumn("shard", F.expr(f"cast((n0 + _place) * {shards} div total as int)"))
        return found.select("doc_id", "size", "text_crc32", "curve", "shard", (rank - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot"))
    if law != "bytes":
        raise ValueError("law: rows or bytes")
    run = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_b", F.col("b0") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    found = found.withColumn("shard", F.expr(f"cast(_b * {shards} div total_bytes as int)")).withColumn("_rank", rank)
    starts = found.groupBy("shard").agg(F.min("_rank").alias("_start"))
    return found.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("_rank") - F.col("_start")).alias("slot"))
