"""Sharding in Hilbert-curve order, DataFrame and SQL functions only.

Several metadata dimensions are quantised to equal-frequency cells, the cells of
a row are turned into its index on a Hilbert curve, rows are sorted by that
index, and the order is cut into runs of equal row counts (law ``rows``: counts
differ by at most one). Neighbours on the curve are neighbours in every
dimension, so each shard spans few cells of each and files can be pruned by any.

The total order is (curve index, text checksum, text hash, doc_id, ...). So a hot source is cut like any other run. With ``together`` (as the query has it) a row's
index is the least one of all rows with an equal text, so equal texts lie together and are cut only where a shard is full.
Least indexes are summed up in SALTS parts for each text before they are joined back, however many rows a text has. The rank of a row is its
place in a range-partitioned sort plus the rows of all partitions before it. The
narrow keys are written to the checkpoint folder before the sort, which reads them twice, and
after it, so a lost executor can't change the order between the reads. No window over all rows is needed, and
the text itself is never shuffled.

Quantile borders come from all rows; there are at most 2^BITS - 1 of them for
each dimension, whatever the input. Those of strings are whole strings, found by a
running sum over the counts of their values.

Defined cases: null text counts as empty (size 1, checksum 0); null metadata
sort before all other values; repeated rows each get a slot; the empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
BITS = 5
SALTS = 64
ACCURACY = 2000

#: Metadata dimensions of documents: origin, language, size.
DIMENSIONS = ("source", "lang", "size")


def _number(column: Column) -> Column:
    """A number in the order of the column; null is the least."""
    return F.coalesce(column.cast("double"), F.lit(float("-inf")))


def _string_borders(df: DataFrame, x: str, cells: int) -> list[str | None]:
    """The quantile borders of a string column, whole strings, from the counts of its values; null is the least."""
    counts = df.groupBy(F.col(x).alias("v")).agg(F.count("*").alias("n"))
    placed = counts.repartitionByRange(common.parallelism(df.sparkSession), "v").sortWithinPartitions("v")
    placed = common.checkpoint(placed.withColumn("__p", F.spark_partition_id()))
    before, total = {}, 0
    for r in placed.groupBy("__p").agg(F.sum("n").alias("n")).orderBy("__p").collect():
        before[r["__p"]] = total
        total += r["n"]
    if not total:
        return []
    start = F.element_at(F.create_map(*[F.lit(k).cast("long") for kv in before.items() for k in kv]), F.col("__p").cast("long"))
    upto = placed.withColumn("__to", start + F.sum("n").over(Window.partitionBy("__p").orderBy("v")))
    # the k-th border is the value of row ceil(k total / cells)
    at = lambda to: F.floor(to * cells / F.lit(total))
    return [r["v"] for r in upto.where(F.least(at(F.col("__to")), F.lit(cells - 1)) > at(F.col("__to") - F.col("n"))).select("v").collect()]


def cells(df: DataFrame, dimensions: tuple[str, ...], bits: int = BITS) -> DataFrame:
    """Adds ``__cell``, the array of quantile cells (0 to 2^bits - 1) of the dimensions."""
    strings = {x for x in dimensions if dict(df.dtypes)[x] == "string"}
    numbers = {x: _number(F.col(x)) for x in dimensions if x not in strings}
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    borders = df.agg(*[F.percentile_approx(c, steps, ACCURACY).alias(x) for x, c in numbers.items()]).first() if numbers else {}

    def below(found: list, value: Column) -> Column:
        return F.array_size(F.filter(F.array(*map(F.lit, found)), lambda b: b < value)).cast("int") if found else F.lit(0)

    def cell(x: str) -> Column:
        if x not in strings:
            return below(sorted({float(b) for b in borders[x] or []}), numbers[x])
        found = _string_borders(df, x, 1 << bits)
        whole = [b for b in found if b is not None]
        return F.when(F.col(x).isNull(), 0).otherwise(below(whole, F.col(x)) + len(found) - len(whole))

    return df.withColumn("__cell", F.array(*[cell(x) for x in dimensions]))


def hilbert(cell: Column, n: int, bits: int = BITS) -> Column:
    """The index on the Hilbert curve of an array of n coordinates of ``bits`` bits
    (the transposed form of Skilling, 2004)."""
    at = lambda a, i: F.get(a, i)

    def turn(x: Column, q: Column) -> Column:
        p = q - 1

        def one(x: Column, i: Column) -> Column:
            t = at(x, F.lit(0)).bitwiseXOR(at(x, i)).bitwiseAND(p)
            flipped = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(p)).otherwise(v))
            swapped = F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(t)).otherwise(v))
            return F.when(at(x, i).bitwiseAND(q) != 0, flipped).when(i == 0, x).otherwise(swapped)

        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), x, one)

    powers = [1 << k for k in range(bits - 1, 0, -1)]
    turned = F.aggregate(F.array(*map(F.lit, powers)), cell, turn) if powers else cell
    empty = F.array().cast("array<int>")
    gray = F.aggregate(turned, empty, lambda a, v: F.concat(a, F.array(F.when(F.size(a) > 0, v.bitwiseXOR(F.element_at(a, -1))).otherwise(v))))
    # the last coordinate decides which bits all coordinates flip
    flip = F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda t, q: F.when(F.element_at(gray, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)) if powers else F.lit(0)
    axes = F.transform(gray, lambda v: v.bitwiseXOR(flip))
    bit = lambda a, k, i: F.shiftright(at(a, F.lit(i)), k).bitwiseAND(F.lit(1)).cast("long")
    out = F.lit(0).cast("long")
    for k in range(bits - 1, -1, -1):
        for i in range(n):
            out = out * 2 + bit(F.col("__axes"), k, i)
    return axes, out


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows with the least curve index of all rows of their text."""
    same = ["__text", "text_crc32", "size"]
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*same, "__salt").agg(F.min("curve").alias("m"), F.count("*").alias("n"))
    whole = parts.groupBy(*same).agg(F.min("m").alias("__least"), F.sum("n").alias("n")).where("n > 1").drop("n")
    least = parts.select(*same, "__salt").join(whole, same)
    return salted.join(least, [*same, "__salt"], "left").withColumn("curve", F.coalesce("__least", "curve")).drop("__least", "__salt")


def ordered(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, key: tuple[str, ...] = (), together: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions, the columns in ``key``, ``curve`` and ``rank``, the place of the row from 0."""
    own = (*(x for x in dimensions if x != "size"), *key)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = common.text_column(docs, "doc_id", "text", *own)
    rows = rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("__text"), *own)
    rows = cells(rows, dimensions, bits)
    axes, index = hilbert(F.col("__cell"), len(dimensions), bits)
    rows = rows.withColumn("__axes", axes).withColumn("curve", index)
    rows = common.checkpoint(rows.drop("__axes", "__cell"))
    if together:
        rows = _gathered(rows)
    order = ["curve", "text_crc32", *["__text"] * together, "doc_id", "size", *own]
    partitions = common.parallelism(docs.sparkSession)
    placed = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = common.checkpoint(placed.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__at"), 33)
    counts = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    # one row for each sorted partition
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    ranked = placed.withColumn("__p", part).join(F.broadcast(before), "__p")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.select("doc_id", "size", "text_crc32", *own, "curve", (F.col("__before") + inside).alias("rank"), F.col("__total").alias("total"))


def shard(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, key: tuple[str, ...] = (), together: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve, and the columns in ``key``."""
    rows = ordered(docs, dimensions, bits, key, together)
    base, more = F.floor(F.col("total") / shards).cast("long"), F.col("total") % shards
    wide = more * (base + 1)  # ranks in the first shards, which hold one row more
    r = F.col("rank")
    number = F.when(r < wide, F.floor(r / (base + 1))).otherwise(more + F.floor((r - wide) / F.greatest(base, F.lit(1)))).cast("int")
    slot = F.when(r < wide, r % (base + 1)).otherwise((r - wide) % F.greatest(base, F.lit(1))).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), number.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *key)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> None:
    """The whole documents as Parquet, a folder for each shard, rows in curve order, for pruning by file
    statistics. Each row has its own place, whatever rows repeat."""
    kept = common.checkpoint(docs.withColumn("__row", F.monotonically_increasing_id()))
    placed = shard(kept, shards, dimensions, key=("__row",)).select("__row", "shard", "slot")
    n = max(common.parallelism(docs.sparkSession), shards)
    joined = kept.join(placed, "__row").drop("__row")
    joined.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").mode("overwrite").parquet(path)
