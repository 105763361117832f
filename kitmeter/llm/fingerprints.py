"""Document fingerprints: a canonical exact digest.

The canonical form of a text is its NFKC form, case-folded, NFKC again, with
every run of white space as one space and none at the ends. Its fingerprint is
the 128-bit XXH3 digest of the UTF-8 bytes, in hex. Documents of equal digests
are in one bucket; inside a bucket the canonical bytes themselves are compared,
and a form that differs from the bucket's first gets the digest with ``-1``,
``-2``, ... so equal fingerprints always mean equal canonical forms.

Edited texts need the neighbour in descending doc_id. The table is dealt into
ranges of doc_id by quantile borders, about RANGE_BYTES of text each; each range is read
in order, and the first document of a range is sent to the range before it as well. So
texts are shuffled once, compressed, and no window over all rows is needed. A row finds
its range by binary search. Only documents
whose digest occurs twice are compared by bytes: each task sends one copy of a
canonical form, whatever the size of a group of copies.

An edited text's fingerprint is its digest; against its own document and the
next one it is compared by bytes, which are at hand, so likeness is 1 for equal
canonical forms and 0 otherwise.

Defined cases: null is the empty text; rows are ordered by doc_id descending,
ties by the bytes of the compressed text, null doc_id last; one row alone is its own next document; repeated
rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

#: Tasks over which the documents of one digest are dealt.
SALTS = 32

#: Text bytes of a range of doc_ids.
RANGE_BYTES = 8 << 20
#: Ranges of a task.
RANGES = 4

#: doc_id of a row without one, for the order only.
_NONE = -(1 << 63)


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split()).encode("utf-8", "surrogatepass")
    return " ".join(text.lower().split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def digests(docs: DataFrame, hasher: Callable[[bytes], str] = digest) -> DataFrame:
    """doc_id and digest of each document; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch):
                found = [hasher(canonical(t or "")) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(found, pa.string())], names=["doc_id", "digest"])

    return common.text_column(docs, "doc_id", "text").mapInArrow(run, "doc_id long, digest string")


def _borders(docs: DataFrame, parts: int) -> list[int]:
    """Ascending doc_id borders of ranges; one number for each range."""
    if parts < 2:
        return []
    steps = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", steps, max(10_000, 10 * parts))).first()[0]
    return sorted(set(found or []))


def _ranges(ids: pa.Array, borders: np.ndarray) -> np.ndarray:
    """The range of each doc_id: 0 holds the largest ones; a border belongs to the range above it."""
    keys = pc.fill_null(ids, _NONE).to_numpy(zero_copy_only=False)
    return (len(borders) - np.searchsorted(borders, keys, side="right")).astype(np.int32)


def _tops(ids: DataFrame, borders: np.ndarray) -> dict[int, int]:
    """The largest doc_id of each range that has any; one number for each range and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full(len(borders) + 1, _NONE, np.int64)
        there = np.zeros(len(top), bool)
        for batch in batches:
            part = _ranges(batch.column("doc_id"), borders)
            np.maximum.at(top, part, pc.fill_null(batch.column("doc_id"), _NONE).to_numpy(zero_copy_only=False))
            there[part] = True
        some = np.flatnonzero(there).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(top[some])], names=["p", "top"])

    return {r["p"]: r["top"] for r in ids.mapInArrow(run, "p int, top long").groupBy("p").agg(F.max("top").alias("top")).collect()}


def _dealt(rows: DataFrame, borders: np.ndarray, tops: dict[int, int]) -> DataFrame:
    """(p, kind, doc_id, packed): each text in its range (kind 1), and those of a range's largest doc_id also in the range before (kind 2)."""
    order = sorted(tops)
    before = np.zeros(len(borders) + 1, np.int32)
    top = np.full(len(borders) + 1, _NONE, np.int64)
    for k, p in enumerate(order):
        # the range before the first is the last
        before[p], top[p] = order[k - 1], tops[p]
    sent = rows.sparkSession.sparkContext.broadcast((borders, before, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders, before, top = sent.value
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in common.chunks(batch):
                ids = part.column("doc_id")
                p = _ranges(ids, borders)
                first = np.flatnonzero(top[p] == pc.fill_null(ids, _NONE).to_numpy(zero_copy_only=False))
                small = pa.array([press.compress(t.encode("utf-8", "surrogatepass")) if t else b"" for t in part.column("text").to_pylist()], pa.binary())
                at = np.concatenate((np.arange(len(p)), first))
                kind = np.repeat(np.array([1, 2], np.int32), (len(p), len(first)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((p, before[p[first]]))), pa.array(kind), ids.take(pa.array(at)), small.take(pa.array(at))], names=["p", "kind", "doc_id", "packed"])

    return rows.mapInArrow(run, "p int, kind int, doc_id long, packed binary")


def fingerprints(docs: DataFrame, hasher: Callable[[bytes], str] = digest) -> DataFrame:
    """A row for each document; see SCHEMA. ``hasher`` makes the digest of a canonical form."""
    spark = docs.sparkSession
    rows = common.text_column(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a task reads several small ranges, dealt by hash, so that tasks are even without a second pass
    parts = max(common.parallelism(spark), math.ceil(size / (RANGES * RANGE_BYTES)))
    borders = np.array(_borders(rows.select("doc_id"), RANGES * parts), np.int64)

    own = common.checkpoint(digests(rows, hasher))
    twice = own.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    # a digest of many documents is dealt over SALTS tasks
    twice = twice.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    marks = salted.join(twice, ["digest", "salt"], "left_semi").select("doc_id").distinct()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_ranges(batch.column("doc_id"), borders)), batch.column("doc_id")], names=["p", "doc_id"])

    texts = _dealt(rows, borders, _tops(own.select("doc_id"), borders))
    flags = marks.mapInArrow(placed, "p int, doc_id long").select("p", F.lit(0).alias("kind"), "doc_id", F.lit(None).cast("binary").alias("packed"))
    dealt = texts.unionByName(flags).withColumn("__k", F.coalesce(F.col("doc_id"), F.lit(_NONE)))
    # kinds 0 and 1 of a document lie together; kind 2 comes after all others of a range
    dealt = dealt.repartition(parts, "p").sortWithinPartitions(F.col("p"), F.col("kind") == 2, F.col("__k").desc(), "kind", "packed").drop("__k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        unpack = lambda b: open_.decompress(b).decode("utf-8", "surrogatepass") if b else ""
        out: list[list] = [[] for _ in range(8)]
        held, held_bytes = None, 0
        at, marked_id, marks_any, marks_null = None, None, False, False

        def close(nxt: str | None) -> None:
            nonlocal held, held_bytes
            if held is None:
                return
            doc, text, form, mark = held
            following = text if nxt is None else nxt
            e = edited(text, following)
            e_form = canonical(e)
            n_form = canonical(following)
            for column, x in zip(out, (doc, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), hasher(form), hasher(e_form), float(e_form == form), float(n_form == form), form if mark else None)):
                column.append(x)
            held_bytes += len(form) if mark else 0
            held = None

        def flush() -> pa.RecordBatch:
            nonlocal out, held_bytes
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[*[x.split()[0] for x in SCHEMA.split(", ")], "form"])
            out, held_bytes = [[] for _ in range(8)], 0
            return batch

        for batch in batches:
            for p, kind, doc, packed in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if p != at:
                    close(None)
                    at, marked_id, marks_any = p, None, False
                if kind == 0:
                    marked_id, marks_any = doc, True
                    continue
                text = unpack(packed)
                close(text)
                if kind == 1:
                    held = (doc, text, canonical(text), marks_any and marked_id == doc)
            if len(out[0]) >= 2000 or held_bytes > common.CHUNK_BYTES:
                yield flush()
        close(None)
        yield flush()

    found = common.checkpoint(dealt.mapInArrow(run, f"{SCHEMA}, form binary"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    # byte comparison inside equal buckets: one row for each distinct form of a digest and task is sent
    forms = found.where("form IS NOT NULL").groupBy("fingerprint", "form").agg(F.min("doc_id").alias("least"))
    several = forms.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("least").alias("least")).where("n > 1").select(F.col("fingerprint"))
    if several.isEmpty():
        return found.select(*names)
    bad = forms.join(several, "fingerprint", "left_semi")

    def number(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["least", "form"], ignore_index=True)
        part["suffix"] = ["" if k == 0 else f"-{k}" for k in range(len(part))]
        return part[["fingerprint", "form", "suffix"]]

    suffixes = bad.groupBy("fingerprint").applyInPandas(number, "fingerprint string, form binary, suffix string")
    fixed = found.join(suffixes, ["fingerprint", "form"], "left").withColumn("fingerprint", F.concat("fingerprint", F.coalesce("suffix", F.lit(""))))
    return fixed.select(*names)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and the smallest doc_id with the same one."""
    found = fingerprints(docs).select("doc_id", "fingerprint")
    least = found.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"))
    return found.join(least, "fingerprint").select("doc_id", "fingerprint", "group_id")
