"""Line deduplication, DataFrame and SQL functions only.

The lines of a document become keys (trimmed, A-Z folded), and each key two 64-bit hashes. A
document sends one narrow row for each of its keys, with the places of the lines; no text is
shuffled for this. The rows are range-partitioned by hash, sorted by hash, document and place, and streamed: the first
document of a hash keeps its lines, those of later ones go. What goes is gathered for each
document as a compressed bitmap of the lines that stay; texts meet their bitmaps only
where they are to be cut.

A line may be in a third of all documents: the ranges are over (hash, salt), the salt a hash of the
document, so one line's rows lie in SALTS runs. Each run keeps its first document, and
what is left, at most SALTS rows for a line, is compared by least document, which is
summed up before it is dealt.

The bitmap is a run-length code: the numbers of lines that stay, go, stay, go ... as
varints of seven bits; the last lines that stay are implied.

Hashes are compared, 128 bits of them, not lines.

Defined cases: a null or empty text is one empty line; keys shorter than LEAST code points never
go; rows of one doc_id are one document, so all of its rows keep the lines it has first; a null
doc_id is one document, the last of all; rows of equal doc_id and text share a bitmap; the empty
table gives no rows; other columns are ignored, and kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .secrets import let, walk

#: Code points of a key that may go.
LEAST = 10
SALTS = 64
_WHITE = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """A line without white space at its ends, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit(_WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def _hashed(text: Column, least: int) -> Column:
    """The keys of a text that may go, (h, g, place), in order."""
    one = lambda line, at: let(key(line), lambda k: F.when(F.length(k) >= least, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g"), at.alias("at"))))
    return F.sort_array(F.filter(F.transform(lines(text), one), lambda x: x.isNotNull()))


def _grouped(found: Column) -> Column:
    """(h, g, places) of sorted keys."""
    own = lambda i: F.get(found, i)
    new = lambda i: (i == 0) | (own(i)["h"] != own(i - 1)["h"]) | (own(i)["g"] != own(i - 1)["g"])
    starts = F.filter(F.sequence(F.lit(0), F.size(found) - 1), new)
    ends = lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(found)))
    group = lambda s, e: F.struct(own(s)["h"].alias("h"), own(s)["g"].alias("g"), F.transform(F.slice(found, s + 1, e - s), lambda x: x["at"]).alias("at"))
    return let(starts, lambda s: F.zip_with(s, ends(s), group))


def _marks(text: Column) -> list[Column]:
    """Two hashes that tell the texts of one doc_id apart."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("t"), F.xxhash64(F.lit(1), t).alias("u")]


def dropped(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, t, u (hashes of the text), n (lines), and the places of lines that go, for each key of which they do."""
    rows = common.text_column(docs, "doc_id", "text")
    rows = rows.select("doc_id", *_marks(F.col("text")), F.size(lines(F.col("text"))).alias("n"), _hashed(F.col("text"), least).alias("found"))
    rows = rows.where(F.size("found") > 0).select("doc_id", "t", "u", "n", F.explode(_grouped(F.col("found"))).alias("k"))
    rows = rows.select("k.h", "k.g", F.pmod(F.xxhash64("doc_id", "t"), F.lit(SALTS)).cast("int").alias("s"), "doc_id", "t", "u", "n", "k.at")
    rows = rows.distinct()  # repeated rows
    run = Window.partitionBy("h", "g", "s").orderBy(F.col("doc_id").asc_nulls_last(), "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.repartitionByRange(common.parallelism(docs.sparkSession), "h", "g", "s")
    placed = common.checkpoint(placed.withColumn("late", ~F.col("doc_id").eqNullSafe(F.first("doc_id").over(run))))
    # the first documents of a line's runs are compared
    firsts = placed.where("NOT late")
    least_of = firsts.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1 AND least IS NOT NULL")
    later = firsts.join(least_of, ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("least")))
    return placed.where("late").select("doc_id", "t", "u", "n", "at").unionByName(later.select("doc_id", "t", "u", "n", "at"))


def _byte(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def _varint(value: Column) -> Column:
    """Groups of seven bits, the lowest first, as hexadecimal bytes; the high bit says that more follow."""
    parts = []
    for k in range(5):
        group = F.shiftright(value, 7 * k).bitwiseAND(F.lit(127))
        parts.append(F.when((value >= 1 << 7 * k) | F.lit(k == 0), _byte(group + F.when(value >= 1 << 7 * (k + 1), 128).otherwise(0))))
    return F.concat_ws("", *parts)


def encode(places: Column) -> Column:
    """The bitmap of the lines that stay, from the sorted places of those that go."""

    def whole(p: Column) -> Column:
        at = lambda i: F.get(p, i).cast("long")
        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (at(i) != at(i - 1) + 1))
        # the lines between the end of the run before and this one, and those of this one
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(p)))
        gap = lambda s: at(s) - F.when(s == 0, F.lit(0).cast("long")).otherwise(at(s - 1) + 1)
        return let(starts, lambda s: F.array_join(F.zip_with(s, ends(s), lambda a, b: F.concat(_varint(gap(a)), _varint((b - a).cast("long")))), ""))

    return F.unhex(let(places, whole))


def decode(bitmap: Column) -> Column:
    """The run lengths of a bitmap: lines that stay, go, stay, go ..."""
    varints = F.regexp_extract_all(F.hex(bitmap), F.lit("(?:[89A-F][0-9A-F])*+[0-7][0-9A-F]"), F.lit(0))
    group = lambda x, k: F.conv(F.substr(x, F.lit(2 * k + 1), F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127)) * (1 << 7 * k)
    value = lambda x: sum((F.when(F.length(x) > 2 * k, group(x, k)).otherwise(0) for k in range(1, 5)), group(x, 0))
    return F.transform(varints, value).cast("array<int>")


def bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, t, u (hashes of the text), n_dropped and ``keep``, the bitmap, of each document that loses lines."""
    gathered = dropped(docs, least).groupBy("doc_id", "t", "u").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("places"))
    return gathered.select("doc_id", "t", "u", F.size("places").cast("long").alias("n_dropped"), encode(F.col("places")).alias("keep"))


def apply(text: Column, bitmap: Column) -> Column:
    """A text without the lines that go."""

    def cut(own: Column, sizes: Column, upto: Column) -> Column:
        last = F.element_at(upto, -1)
        part = lambda k: F.slice(own, F.get(upto, k) - F.get(sizes, k) + 1, F.get(sizes, k))
        stays = F.transform(F.sequence(F.lit(0), F.size(sizes) - 2, F.lit(2)), part)
        return F.array_join(F.concat(F.flatten(stays), F.slice(own, last + 1, F.size(own))), "\n")

    whole = let(lines(text), lambda own: let(decode(bitmap), lambda sizes: let(walk(sizes, 0, lambda at, n: at + n), lambda upto: cut(own, sizes, upto))))
    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(whole)


def _joined(docs: DataFrame, text: str, doc_id: str, found: DataFrame) -> DataFrame:
    """The documents with n_dropped and keep, null where nothing goes, as __n_dropped and __keep."""
    right = found.select(*[F.col(x).alias(f"__{x}") for x in ("doc_id", "t", "u", "n_dropped", "keep")])
    t, u = _marks(F.col(text))
    return docs.join(right, F.col(doc_id).eqNullSafe(F.col("__doc_id")) & (t == F.col("__t")) & (u == F.col("__u")), "left")


def digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the digest of the lines that stay."""
    joined = _joined(common.text_column(docs, "doc_id", "text"), "text", "doc_id", bitmaps(docs, least))
    return joined.select("doc_id", F.size(lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce("__n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.sha2(apply(F.col("text"), F.col("__keep")), 256).alias("kept_sha256"))


def deduplicate(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents without repeated lines; texts that lose none stay as they are. n_chars, where there is one, is set anew."""
    names = docs.columns
    own = [x if x in ("doc_id", "text") else f"c{k}" for k, x in enumerate(names)]
    joined = _joined(docs.toDF(*own), "text", "doc_id", bitmaps(docs, least))
    changed = F.col("__keep").isNotNull()
    joined = joined.withColumn("__new", F.when(changed, apply(F.col("text"), F.col("__keep"))).otherwise(F.col("text")))
    out = []
    for name, x in zip(names, own):
        value = F.col("__new") if x == "text" else F.col(x)
        if name == "n_chars":
            value = F.when(changed, F.length("__new")).otherwise(value).cast(docs.schema[name].dataType)
        out.append(value.alias(name))
    return joined.select(*out)
