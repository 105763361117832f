"""Benchmark decontamination by a distributed positional inverted index.

The training documents are indexed once: the index is a table of chunks of documents,
each with its dictionary (the bytes of its terms, in order of their hashes) and the
postings of each term, its positions in the chunk, written as Parquet in the shared
folder. Any number of benchmarks are asked of it without reading a text again.

Every benchmark window is a phrase query. Its terms are looked up in a chunk's
dictionary by hash and compared by bytes; a window with a term that is not there is
out at once. The others start from the shortest posting list, that of the rarest
term, which is intersected with the offset-adjusted lists of the other terms, rarest
first. What lies within ``slop`` words of each expected place is a proximity match,
what lies exactly there is an exact phrase match.

The index is partitioned by documents, so postings are never shuffled and no
term, however frequent, gathers anywhere. Benchmark items are a stated query
set: they are sent in blocks of about BLOCK_BYTES of text, dealt by item and text, each block one pass
over the index, whose hits are written before the next one. Candidates are looked at
in steps of about STEP.

Defined cases: a null or empty text or one without words has no words and no
hits; an item without words asks nothing; an item of fewer words than a window
is one window; a null item_id is the item "null"; repeated item ids are one
item; repeated documents each get their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
SLOP = 2
BLOCK_BYTES = 8 << 20

#: Candidate places that are looked at in one step.
STEP = 1 << 18
#: Documents with hits that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000

#: Positions between two documents of a chunk, so that no match spans both.
GAP = 1024

#: Blobs are compressed already; small row groups keep little of them in memory.
_WRITE = {"compression": "none", "parquet.block.size": str(8 << 20)}

INDEX = "doc_ids array<long>, keys array<long>, n_words array<long>, hashes binary, sizes binary, spelled binary, lengths binary, postings binary"
HITS = "chunk long, number int, items array<string>, near array<string>, spans array<int>, near_spans array<struct<item:string,first_word:int,end_word:int>>"


class Queries:
    """The windows of one block of benchmark items as rows of term numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({x for x, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        data, starts, ends, counts = _words(pa.array([t for _, t in items], pa.string()))
        hashes = common.word_hashes(data, starts, ends)
        self.terms, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.words = [data[starts[i] : ends[i]].tobytes() for i in first.tolist()]
        by_length: dict[int, dict[tuple, set]] = {}
        at = 0
        for (name, _), n in zip(items, counts.tolist()):
            own = ids[at : at + n]
            at += n
            size = min(window, n)
            for k in range(n - size + 1 if n else 0):
                by_length.setdefault(size, {}).setdefault(tuple(own[k : k + size].tolist()), set()).add(number[name])
        self.windows = {size: (np.array(list(w), np.int64), [sorted(x) for x in w.values()]) for size, w in by_length.items()}


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = common.utf8(texts)
    data = common.LOWER[data]
    return data, *common.words(data, offsets, common.ALNUM)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of a table of documents, one row for each chunk: its documents (doc_ids, keys, the
    xxhash64 of their texts, n_words), and zstandard blobs: hashes (of its terms, ascending), sizes and
    spelled (their bytes), lengths (of their posting lists) and postings (positions, as steps from the
    one before in the list). Positions of two documents differ by at least GAP."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        small = lambda x: press.compress(np.ascontiguousarray(x).tobytes())
        for batch in batches:
            for part in common.chunks(batch):
                data, starts, ends, counts = _words(part.column("text"))
                terms, first, ids = np.unique(common.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                at = np.arange(len(ids)) + np.repeat(np.arange(len(counts)) + 1, counts) * GAP
                order = np.argsort(ids, kind="stable")
                lengths = np.bincount(ids, minlength=len(terms))
                steps = np.diff(at[order], prepend=0)
                begin = np.cumsum(lengths) - lengths
                steps[begin] = at[order[begin]]
                spelled = b"".join(data[starts[i] : ends[i]].tobytes() for i in first.tolist())
                planes = steps.astype("<u4").view(np.uint8).reshape(-1, 4).T
                row = [part.column("doc_id").to_pylist(), part.column("key").to_pylist(), counts.tolist(), small(terms), small((ends - starts)[first].astype("<u4")), press.compress(spelled), small(lengths.astype("<u4")), small(planes)]
                kinds = (*[pa.list_(pa.int64())] * 3, *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

    return rows.mapInArrow(common.task(run), INDEX)


class Postings:
    """Positional postings of a chunk of documents, for the terms of the queries."""

    def __init__(self, queries: Queries, row: dict, open_: zstandard.ZstdDecompressor):
        read = lambda x, kind: np.frombuffer(open_.decompress(row[x]), kind)
        terms, sizes, lengths = read("hashes", "<u8"), read("sizes", "<u4").astype(np.int64), read("lengths", "<u4").astype(np.int64)
        self.n_words = np.array(row["n_words"], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n_words)))
        v = len(queries.terms)
        self.counts = np.zeros(v, np.int64)
        self.begin = np.zeros(v, np.int64)
        self.keys = self.doc = np.zeros(0, np.int64)
        if not v or not len(terms):
            return
        near = np.minimum(np.searchsorted(terms, queries.terms), len(terms) - 1)
        known = np.flatnonzero(terms[near] == queries.terms)
        spelled, upto = open_.decompress(row["spelled"]), np.cumsum(sizes)
        same = [spelled[upto[t] - sizes[t] : upto[t]] == queries.words[q] for q, t in zip(known.tolist(), near[known].tolist())]
        known = known[np.array(same, bool)]
        own = near[known]
        self.counts[known] = lengths[own]
        self.begin = np.cumsum(self.counts) - self.counts
        steps = np.ascontiguousarray(read("postings", np.uint8).reshape(4, -1).T).view("<u4").ravel()
        # the wanted lists one after another
        n = lengths[own]
        begin = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(begin - (np.cumsum(lengths) - lengths)[own], n)
        sums = np.cumsum(steps[at].astype(np.int64))
        position = sums - np.repeat(np.concatenate(([0], sums))[begin], n)
        self.keys = np.repeat(known, n) << 40 | position
        starts = self.first[:-1] + (np.arange(len(self.n_words)) + 1) * GAP
        self.doc = np.searchsorted(starts, position, side="right") - 1

    def matches(self, windows: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window number, document, first word in the document, exact) of each match, step by step."""
        if not len(self.keys):
            return
        lists = self.counts[windows]
        alive = np.flatnonzero(lists.min(axis=1) > 0)
        order = np.argsort(lists[alive], axis=1, kind="stable")
        upto = np.cumsum(lists[alive].min(axis=1))
        k = 0
        while k < len(alive):
            end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + STEP, side="right")))
            yield self._some(windows, alive[k:end], order[k:end], slop)
            k = end

    def _some(self, windows: np.ndarray, alive: np.ndarray, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rarest = windows[alive, order[:, 0]]
        n = self.counts[rarest]
        row = np.repeat(np.arange(len(alive)), n)
        posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.begin[rarest][row]
        doc = self.doc[posting]
        start = (self.keys[posting] & ((1 << 40) - 1)) - order[row, 0]
        keys = np.append(self.keys, np.int64(1) << 62)
        length = windows.shape[1]
        for j in range(1, length):
            offset = order[row, j]
            want = (windows[alive[row], offset] << 40) | (start + offset)
            keep = keys[np.searchsorted(keys, want - slop)] <= want + slop
            row, doc, start = row[keep], doc[keep], start[keep]
            if not len(row):
                break
        exact = np.ones(len(row), bool)
        for j in range(1, length):
            offset = order[row, j]
            want = (windows[alive[row], offset] << 40) | (start + offset)
            exact &= keys[np.searchsorted(keys, want)] == want
        return alive[row], doc, start - (doc + 1) * GAP - self.first[doc], exact


def scan(queries: Queries, postings: Postings, slop: int) -> dict[int, list[tuple[int, int, int, bool]]]:
    """The matches (item number, first word, words, exact) of each document of a chunk that has any."""
    found: dict[int, list[tuple[int, int, int, bool]]] = {}
    for size, (windows, items) in queries.windows.items():
        for step in postings.matches(windows, slop):
            for w, d, s, x in zip(*(a.tolist() for a in step)):
                found.setdefault(d, []).extend((i, s, size, x) for i in items[w])
    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Of a written index, the documents with matches: chunk and number (of the document in it), items
    (found exactly), near (found exactly or nearby), spans (the hit words as merged [start, end) pairs
    in a flat list), near_spans (item, first word, end word of nearby matches that are not exact)."""
    if window + slop >= GAP:
        raise ValueError("a window must be shorter than the gap between documents")
    spark = index.sparkSession
    items = common.text_column(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    near = pa.struct([("item", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())])
    found = None
    for k in range(blocks):
        block = [(r[0], r[1]) for r in (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)).collect()]
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries, open_ = Queries(sent.value, window), zstandard.ZstdDecompressor()
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    out: list[list] = [[] for _ in range(6)]
                    for d, matches in sorted(scan(queries, Postings(queries, row, open_), slop).items()):
                        exact = {(m[0], m[1]) for m in matches if m[3]}
                        spans = _merged([(m[1], m[1] + m[2]) for m in matches if m[3]])
                        nearby = sorted({(queries.names[m[0]], m[1], m[1] + m[2]) for m in matches if (m[0], m[1]) not in exact})
                        values = (row["chunk"], d, sorted({queries.names[i] for i, _ in exact}), sorted({queries.names[m[0]] for m in matches}), [y for x in spans for y in x], [dict(zip(("item", "first_word", "end_word"), x)) for x in nearby])
                        for column, x in zip(out, values):
                            column.append(x)
                    kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(near))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["chunk", "number", "items", "near", "spans", "near_spans"])

        hits = common.checkpoint(index.select("chunk", "n_words", "hashes", "sizes", "spelled", "lengths", "postings").mapInArrow(common.task(run), HITS))
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    if blocks == 1:
        return found
    every = lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_list(x))))
    pairs = F.transform(F.filter("spans", lambda _, i: i % 2 == 0), lambda s, i: F.struct(s.alias("s"), F.get("spans", 2 * i + 1).alias("e")))
    merged = found.withColumn("spans", pairs).groupBy("chunk", "number").agg(every("items").alias("items"), every("near").alias("near"), every("spans").alias("spans"), every("near_spans").alias("near_spans"))

    def join(a: Column, x: Column) -> Column:
        more = F.struct(x["s"].alias("s"), x["e"].alias("e"))
        last = F.element_at(a, -1)
        wider = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(a) > 0) & (x["s"] <= F.get(a, F.size(a) - 1)["e"]), wider).otherwise(F.concat(a, F.array(more)))

    spans = F.aggregate("spans", F.array().cast("array<struct<s:int,e:int>>"), join)
    return merged.withColumn("spans", F.flatten(F.transform(spans, lambda x: F.array(x["s"], x["e"]))))


def write_index(docs: DataFrame, path: str) -> DataFrame:
    """Writes the index of a table of documents and returns it; ``chunk`` numbers its rows."""
    build_index(common.text_column(docs, "doc_id", "text")).withColumn("chunk", F.monotonically_increasing_id()).write.options(**_WRITE).parquet(path)
    return docs.sparkSession.read.parquet(path)


def _own_path(spark: SparkSession) -> str:
    common.ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"index-{uuid.uuid4().hex}")


def _judged(index: DataFrame, hits: DataFrame) -> DataFrame:
    """A row for each document of an index, with its key and what was found in it."""
    documents = index.select("chunk", F.posexplode(F.arrays_zip("doc_ids", "keys", "n_words")).alias("number", "x")).select("chunk", "number", F.col("x.doc_ids").alias("doc_id"), F.col("x.keys").alias("key"), F.col("x.n_words").alias("n_words"))
    few = common.small(hits, BROADCAST_ROWS)
    found = documents.join(F.broadcast(hits) if few else hits, ["chunk", "number"], "left")
    none = F.array().cast("array<string>")
    found = found.withColumns({"items": F.coalesce("items", none), "near": F.coalesce("near", none), "spans": F.coalesce("spans", F.array().cast("array<int>")), "near_spans": F.coalesce("near_spans", F.array().cast("array<struct<item:string,first_word:int,end_word:int>>"))})
    ends, begins = F.filter("spans", lambda _, i: i % 2 == 1), F.filter("spans", lambda _, i: i % 2 == 0)
    total_of = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id",
        "n_words",
        (total_of(ends) - total_of(begins)).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near_items"),
        "items",
        "spans",
        "near_spans",
        "key",
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, index: DataFrame | None = None) -> DataFrame:
    """A row for each document with the counts, the items found exactly, the hit words as a
    flat list of merged [start, end) pairs, and the proximity matches. ``index``: what
    ``write_index`` returned for these documents, to ask another benchmark of it."""
    index = index or write_index(docs, _own_path(docs.sparkSession))
    return _judged(index, search(index, benchmark, window, slop)).drop("key")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """A row for each hit span of a document: doc_id, first word, end word."""
    found = contamination(docs, benchmark, window, slop).where("contaminated")
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct(F.get("spans", i).alias("first_word"), F.get("spans", i + 1).alias("end_word")))
    return found.select("doc_id", "items", F.explode(pairs).alias("s")).select("doc_id", "items", "s.*")


def brute_force(texts: list[str | None], items: list[tuple], window: int = WINDOW) -> list[tuple[int, int, int, str, bool]]:
    """The definition, word by word, for tests: n_words, n_hit, n_items, digest, contaminated."""
    import re

    fold = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    out = []
    for t in texts:
        w, hit, names = cut(t), set(), set()
        for name, text in items:
            q = cut(text)
            size = min(window, len(q))
            for k in range(len(q) - size + 1 if q else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == q[k : k + size]:
                        hit.update(range(p, p + size))
                        names.add(str(name))
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with their own columns. Rows of one doc_id and text share a verdict."""
    names = docs.columns
    own = [x if x in ("doc_id", "text") else f"c{k}" for k, x in enumerate(names)]
    df = docs.toDF(*own)
    path = _own_path(df.sparkSession)
    index = write_index(df, path)
    judged = _judged(index, search(index, benchmark, window, 0)).where("contaminated")
    bad = common.checkpoint(judged.select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct())
    common.remove(df.sparkSession, path)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_key"))
    return df.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, same, "left_anti").toDF(*names)
