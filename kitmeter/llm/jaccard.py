"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

A document is its set of 64-bit n-gram hashes; two documents link when
100 |A and B| >= 85 |A or B|. The product of the incidence matrix with its
transpose is never formed whole:

1. Copies are one row: documents of equal sets (a 128-bit digest of the set) share a node.
2. Frequencies: tasks send sorted blocks of distinct hashes with their counts (about three bytes a hash), each
   range of hashes is counted by one task, and hashes in more than HEAVY sets
   are kept, at most HEAVY_MOST of them (those of the highest counts), so what
   is broadcast has a fixed bound.
3. Rows are cut to the part that a partner must meet. In an order of all n-grams
   that puts light before heavy ones, and heavy ones by frequency, two sets that
   link share an n-gram among their first n - ceil(0.85 n) + 1.
4. Light columns: the postings of a block of hashes meet in one task, which
   accumulates overlap counts of pairs and discards those whose sizes bound the
   overlap below what 0.85 needs. Lists are short, since frequent n-grams come last. The counts of a pair are added up, and
   the pair goes unless they and what either row has left can reach the need.
   What is left is bounded once more by per-block set sizes: the overlap is at most the sum of the smaller counts of
   n-grams in each of CELLS blocks. Then whole sets are compared.
5. Rows that reach into heavy columns are mostly text that is repeated often, as
   large groups of near copies. They are grouped by the heavy columns they share
   (connected components) and each group is multiplied block by block, BLOCK rows
   to a block, which gives the number of links of each row, and a spanning forest
   of the links for the components, so all pairs are counted and none is stored.
6. Components of the links are found by star contraction (``graph``).

Any order gives the same links, so a bound on the heavy set changes the work
only. No pair is capped or sampled. Sets are compared by hashes.

Defined cases: a text without words, empty or null: no n-grams, linked with
nothing, its own component; fewer words than n: the whole sequence is one
n-gram; copies, repeated rows and repeated doc_ids are one component with their
texts' equals; a null doc_id counts as the largest; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

NGRAM = 4
#: A link needs SHARE hundredths of the union.
SHARE = 85
HEAVY = 32
HEAVY_MOST = 1 << 20
CELLS = 64
BLOCK = 1024
#: Text bytes whose postings one task counts.
RANGE_BYTES = 8 << 20
#: Candidate documents whose numbers may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000

_FLUSH = 1 << 21
#: Pairs of a block of postings that are looked at in one step.
_PAIRS = 1 << 18
_SHIFT = np.uint64(20)
_FIXED = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def multiplier(k: int) -> np.uint64:
    """The odd number of the k-th word of an n-gram."""
    return _FIXED[k] if k < len(_FIXED) else common.mix(np.array([k], np.uint64))[0] | np.uint64(1)


def sets(texts: pa.Array, n: int = NGRAM) -> list[np.ndarray]:
    """The sorted n-gram hashes of each text."""
    data, offsets = common.utf8(texts)
    data = common.LOWER[data]
    starts, ends, counts = common.words(data, offsets, common.SOLID)
    h = common.word_hashes(data, starts, ends)
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        grams += h[k : k + len(grams)] * multiplier(k)
    grams = common.mix(grams)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            own = np.sort(grams[at : at + c - n + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif c:
            short = xxhash.xxh3_64_intdigest(h[at : at + c].tobytes(), seed=c)
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def digest(own: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def needed(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> np.ndarray:
    """The least overlap with which sets of these sizes link."""
    return -(-share * (a + b) // (100 + share))


def prefix_length(n: int, share: int = SHARE) -> int:
    return n - (share * n + 99) // 100 + 1


#: A hash head less the one before it, and the sets of a block that hold it.
_COUNTED = np.dtype([("step", "<u8"), ("n", "<u4")])


def _heavy(docs: DataFrame, n: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hash heads (44 bits) of frequent n-grams, and their frequencies."""

    def block(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        # an n-gram is sent once for a block, with the number of its sets there
        heads, counts = np.unique(np.concatenate(held) >> _SHIFT, return_counts=True)
        cut = np.searchsorted(heads, [np.uint64((k << 44) // ranges) for k in range(ranges + 1)])
        press = zstandard.ZstdCompressor(level=1)
        keys, blobs = [], []
        for k in range(ranges):
            own = heads[cut[k] : cut[k + 1]]
            if len(own):
                rows = np.zeros(len(own), _COUNTED)
                rows["step"], rows["n"] = np.diff(own, prepend=np.uint64(0)), counts[cut[k] : cut[k + 1]]
                # byte planes: the high ones are nearly all zero
                blobs.append(press.compress(np.ascontiguousarray(rows.view(np.uint8).reshape(len(own), -1).T).tobytes()))
                keys.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["range", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in common.chunks(batch):
                own = sets(part.column("text"), n)
                held += own
                size += sum(map(len, own))
                if size > _FLUSH:
                    yield from block(held)
                    held, size = [], 0
        yield from block(held)

    def count(part: pd.DataFrame) -> pd.DataFrame:
        open_ = zstandard.ZstdDecompressor()
        values, counts = [], []
        for b in part["blob"]:
            planes = np.frombuffer(open_.decompress(b), np.uint8).reshape(_COUNTED.itemsize, -1)
            rows = np.array(planes.T, order="C").reshape(-1).view(_COUNTED)
            values.append(np.cumsum(rows["step"], dtype=np.uint64))
            counts.append(rows["n"].astype(np.int64))
        values, counts = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(values)
        values = values[order]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        df = np.add.reduceat(counts[order], first)
        keep = df > HEAVY
        return pd.DataFrame({"h": values[first[keep]].astype(np.int64), "df": df[keep].astype(np.int64)})

    found = docs.select("text").mapInArrow(common.task(run), "range int, blob binary").groupBy("range").applyInPandas(count, "h long, df long")
    found = common.checkpoint(found)
    kept = found.orderBy(F.desc("df"), "h").limit(HEAVY_MOST).toPandas().sort_values("h")
    return kept["h"].to_numpy().astype(np.uint64), kept["df"].to_numpy()


def cut_rows(own: np.ndarray, heads: np.ndarray, df: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The light and the heavy n-grams of a row's prefix, in order."""
    p = prefix_length(len(own), share)
    if len(heads):
        at = np.minimum(np.searchsorted(heads, own >> _SHIFT), len(heads) - 1)
        heavy = heads[at] == own >> _SHIFT
        light = own[~heavy]
        if len(light) >= p:
            return light[:p], own[:0]
        rest, freq = own[heavy], df[at[heavy]]
        return light, rest[np.lexsort((rest, freq))][: p - len(light)]
    return own[:p], own[:0]


_ROW = np.dtype([("h", "<u8"), ("node", "<i8"), ("n", "<i4")])


def pack_rows(rows: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Postings in hash order as byte planes of steps, which compress to about half."""
    out = rows.copy()
    out["h"][1:] -= rows["h"][:-1]
    return press.compress(np.ascontiguousarray(out.view(np.uint8).reshape(len(out), -1).T).tobytes())


def unpack_rows(blob: bytes, open_: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(open_.decompress(blob), np.uint8).reshape(_ROW.itemsize, -1)
    rows = np.array(planes.T, order="C").reshape(-1).view(_ROW)
    rows["h"] = np.cumsum(rows["h"], dtype=np.uint64)
    return rows


def list_pairs(rows: np.ndarray, share: int = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a < b) of nodes and their overlap counts in the postings of a block, without those that sizes exclude."""
    rows = rows[np.lexsort((rows["n"], rows["h"]))]
    first = np.flatnonzero(np.concatenate(([True], rows["h"][1:] != rows["h"][:-1])))
    length = np.diff(np.append(first, len(rows)))
    names, node = np.unique(rows["node"], return_inverse=True)
    n = rows["n"].astype(np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def sums() -> tuple[np.ndarray, np.ndarray]:
        if len(held) < 2:
            return held[0] if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([k for _, k in held])).astype(np.int64)

    # a row meets those after it in its list that are not too large to link with it
    last = np.repeat(first + length, length)
    most = n * 100 // share
    if len(rows):
        # ends of the runs (list, n <= most): lists are in order and n in order inside each
        order = np.repeat(np.arange(len(first)), length)
        wide = int(n.max()) + 1
        last = np.minimum(last, np.searchsorted(order * wide + n, order * wide + np.minimum(most, wide - 1), side="right"))
    meets = last - np.arange(len(rows)) - 1
    upto = np.cumsum(meets)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, side="right")))
        own = meets[at:end]
        x = np.repeat(np.arange(at, end), own)
        y = np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + x + 1
        a, b = node[x], node[y]
        codes, counts = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b), return_counts=True)
        held.append((codes, counts))
        size += len(codes)
        if size > 4 * _PAIRS:
            held = [sums()]
            size = len(held[0][0])
        at = end
    codes, counts = sums()
    return names[codes // max(len(names), 1)], names[codes % max(len(names), 1)], counts


def _binary(x: np.ndarray) -> bytes:
    return x.tobytes()


def product_links(a: list[np.ndarray], b: list[np.ndarray] | None, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of two blocks (of one block if b is None): a dense product over the columns that occur twice, in slices."""
    rows = a if b is None else a + b
    sizes = np.array([len(x) for x in rows], np.int64)
    every = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    columns, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    keep = counts[inverse] > 1
    number = np.cumsum(counts > 1) - 1
    column, owner = number[inverse[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    left = len(a)
    right = 0 if b is None else left
    overlap = np.zeros((left, len(rows) - right), np.float32)
    total = int(number[-1]) + 1 if len(number) else 0
    for s in range(0, total, 2048):
        lo, hi = np.searchsorted(column, [s, s + 2048])
        part = np.zeros((len(rows), min(2048, total - s)), np.float32)
        part[owner[lo:hi], column[lo:hi] - s] = 1
        overlap += part[:left] @ part[right:].T
    need = needed(sizes[:left, None], sizes[None, right:], share)
    i, j = np.nonzero(overlap >= need)
    j = j + right
    ok = i < j
    return i[ok], j[ok]


def forest(links: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """As few of the links as connect the same rows."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in links:
        p, q = root(i), root(j)
        if p != q:
            parent[q] = p
            out.append((i, j))
    return out


class Join:
    """Nodes (distinct sets) of a table of documents and the links between them."""

    def __init__(self, docs: DataFrame, n: int = NGRAM, share: int = SHARE):
        self.spark, self.n, self.share = docs.sparkSession, n, share
        self.docs = common.text_column(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.ranges = max(common.parallelism(self.spark), math.ceil(size / RANGE_BYTES))
        self.heads, self.df = _heavy(self.docs, n, self.ranges)
        self.nodes = self._nodes()

    def signed(self) -> DataFrame:
        """doc_id, n, fp of each document."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.chunks(batch):
                    own = sets(part.column("text"), n)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in own], pa.int64()), pa.array(map(digest, own), pa.binary())], names=["doc_id", "n", "fp"])

        return self.docs.mapInArrow(common.task(run), "doc_id long, n long, fp binary")

    def _nodes(self) -> DataFrame:
        """node, doc_id, n, fp, light, heavy, cells, and copies, the documents of the set, of each distinct set; a task sends one row for each set and chunk."""
        n, share = self.n, self.share
        sent = self.spark.sparkContext.broadcast((self.heads, self.df))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heads, df = sent.value
            for batch in batches:
                for part in common.chunks(batch):
                    kept: dict[bytes, tuple] = {}
                    copies: Counter[bytes] = Counter()
                    for doc, own in zip(part.column("doc_id").to_pylist(), sets(part.column("text"), n)):
                        fp = digest(own)
                        if fp is None:
                            continue
                        copies[fp] += 1
                        if fp in kept:
                            old = kept[fp][0]
                            if doc is not None and (old is None or doc < old):
                                kept[fp] = (doc, *kept[fp][1:])
                            continue
                        light, heavy = cut_rows(own, heads, df, share)
                        cells = np.bincount((own >> np.uint64(14)).astype(np.int64) & (CELLS - 1), minlength=CELLS)
                        kept[fp] = (doc, len(own), fp, *map(_binary, (light, heavy, cells.astype("<u2" if cells.max() < 65536 else "<u4"))))
                    columns = [*(list(zip(*kept.values())) or [()] * 6), [copies[fp] for fp in kept]]
                    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n", "fp", "light", "heavy", "cells", "copies"])

        rows = self.docs.mapInArrow(common.task(run), "doc_id long, n int, fp binary, light binary, heavy binary, cells binary, copies long")
        one = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"), *[F.first(x).alias(x) for x in ("n", "light", "heavy", "cells")])
        return common.checkpoint(one.withColumn("node", F.monotonically_increasing_id()))

    def _candidates(self) -> DataFrame:
        """Pairs (a, b) of nodes that share light prefix n-grams and that no bound excludes."""
        ranges, share = self.ranges, self.share

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            press = zstandard.ZstdCompressor(level=1)
            for batch in batches:
                for part in common.chunks(batch, "light", 8 * common.CHUNK_BYTES):
                    rows = []
                    for node, n, light in zip(part.column("node").to_pylist(), part.column("n").to_pylist(), part.column("light").to_pylist()):
                        h = np.frombuffer(light, "<u8")
                        own = np.empty(len(h), _ROW)
                        own["h"], own["node"], own["n"] = h, node, n
                        rows.append(own)
                    every = np.concatenate(rows)
                    every = every[np.argsort(every["h"], kind="stable")]
                    cut = np.searchsorted(every["h"], [np.uint64((k << 64) // ranges) for k in range(ranges)])
                    cut = np.append(cut, len(every))
                    there = [k for k in range(ranges) if cut[k] < cut[k + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([pack_rows(every[cut[k] : cut[k + 1]], press) for k in there], pa.binary())], names=["range", "rows"])

        def multiply(part: pd.DataFrame) -> pd.DataFrame:
            open_ = zstandard.ZstdDecompressor()
            a, b, c = list_pairs(np.concatenate([unpack_rows(x, open_) for x in part["rows"]]), share)
            return pd.DataFrame({"a": a, "b": b, "overlap": c})

        postings = self.nodes.select("node", "n", "light").mapInArrow(common.task(deal), "range int, rows binary")
        pairs = postings.groupBy("range").applyInPandas(multiply, "a long, b long, overlap long")
        pairs = pairs.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
        cells = self.nodes.select("node", "n", "cells", (F.col("n") - F.octet_length("light") / 8).cast("int").alias("rest"))
        bounded = pairs.join(cells.withColumnsRenamed({"node": "a", "n": "na", "cells": "ca", "rest": "ra"}), "a").join(cells.withColumnsRenamed({"node": "b", "n": "nb", "cells": "cb", "rest": "rb"}), "b")
        # what is not counted yet comes, in the order of all n-grams, after the last counted one of either row
        bounded = bounded.where(100 * (F.col("overlap") + F.greatest("ra", "rb")) + share * (F.col("overlap") + F.greatest("ra", "rb")) >= share * (F.col("na") + F.col("nb")))

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = lambda x: np.frombuffer(x, "<u2" if len(x) == 2 * CELLS else "<u4").astype(np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (np.stack([read(v) for v in batch.column(c).to_pylist()]) for c in ("ca", "cb"))
                most = np.minimum(x, y).sum(axis=1)
                need = needed(batch.column("na").to_numpy().astype(np.int64), batch.column("nb").to_numpy().astype(np.int64), share)
                yield batch.filter(pa.array(most >= need)).select(["a", "b"])

        return bounded.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(common.task(bound), "a long, b long")

    def _sets_of(self, wanted: DataFrame) -> DataFrame:
        """(fp, own): the whole sets of some nodes (node, doc_id, fp), from the texts; dealt by fp."""
        n = self.n
        ids = wanted.select(F.col("doc_id").alias("__id")).distinct()
        near = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        texts = self.docs.join(near, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.chunks(batch):
                    own = {digest(x): x for x in sets(part.column("text"), n) if len(x)}
                    yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.binary()), pa.array(map(_binary, own.values()), pa.binary())], names=["fp", "own"])

        return texts.mapInArrow(common.task(run), "fp binary, own binary").groupBy("fp").agg(F.first("own").alias("own"))

    def _light_links(self, pairs: DataFrame, wanted: DataFrame, own: DataFrame) -> DataFrame:
        """Links among candidate pairs: the sets of a node's partners meet the node's own."""
        share = self.share
        sides = pairs.select(F.col("a").alias("at"), F.col("b").alias("node")).unionByName(pairs.select(F.col("a").alias("at"), F.col("a").alias("node")).distinct())

        def verify(part: pd.DataFrame) -> pd.DataFrame:
            at = part["at"].iloc[0]
            rows = dict(zip(part["node"], (np.frombuffer(x, "<u8") for x in part["own"])))
            mine = rows.pop(at)
            out = [b for b, x in rows.items() if len(np.intersect1d(mine, x, assume_unique=True)) >= needed(np.int64(len(mine)), np.int64(len(x)), share)]
            return pd.DataFrame({"a": np.full(len(out), at, np.int64), "b": np.array(out, np.int64)})

        # narrow rows get their fp first, so the sets are not dealt anew for the join
        named = sides.join(wanted.select("node", "fp"), "node")
        return named.join(own, "fp").select("at", "node", "own").groupBy("at").applyInPandas(verify, "a long, b long")

    def _heavy_groups(self) -> DataFrame:
        """(node, component) of rows that share heavy prefix n-grams."""

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [np.frombuffer(x, "<i8") for x in batch.column("heavy").to_pylist()]
                node = np.repeat(batch.column("node").to_numpy(), [len(x) for x in rows])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)), pa.array(node)], names=["h", "node"])

        rows = common.checkpoint(self.nodes.where(F.octet_length("heavy") > 0).select("node", "heavy").mapInArrow(common.task(split), "h long, node long"))
        return graph.components(graph.with_least(rows, "h", "node").select(F.col("m").alias("a"), F.col("node").alias("b")))

    def _heavy_links(self, groups: DataFrame, wanted: DataFrame, own: DataFrame) -> DataFrame:
        """Of the links inside each group, block by block: a spanning forest (a, b), and rows
        (a, null, links) whose sum for a node is the number of documents it links with."""
        share = self.share
        blocks = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
        placed = groups.join(blocks, "component").withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
        # a row goes to the products of its block with every other, from either side
        placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        placed = placed.select("node", "component", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), F.col("i").alias("side"))

        def multiply(part: pd.DataFrame) -> pd.DataFrame:
            x, y = part["x"].iloc[0], part["y"].iloc[0]
            if x != y:
                part = part.sort_values("side")
            rows = [np.frombuffer(v, "<u8") for v in part["own"]]
            nodes, copies = part["node"].to_numpy(), part["copies"].to_numpy()
            m = int((part["side"] == x).sum())
            i, j = product_links(rows, None, share) if x == y else product_links(rows[:m], rows[m:], share)
            linked = np.zeros(len(rows), np.int64)
            np.add.at(linked, i, copies[j])
            np.add.at(linked, j, copies[i])
            kept = np.array(forest(zip(i.tolist(), j.tolist())), np.int64).reshape(-1, 2)
            some = np.flatnonzero(linked)
            a, b = np.append(nodes[kept[:, 0]], nodes[some]), np.append(nodes[kept[:, 1]], np.zeros(len(some), np.int64))
            counts = np.append(np.zeros(len(kept), np.int64), linked[some])
            return pd.DataFrame({"a": a, "b": pd.Series(b, dtype="Int64").mask(counts > 0), "links": counts})

        named = placed.join(wanted.select("node", "fp", "copies"), "node")
        return named.join(own, "fp").drop("fp").groupBy("component", "x", "y").applyInPandas(multiply, "a long, b long, links long")

    def _light_counts(self, light: DataFrame, groups: DataFrame, wanted: DataFrame) -> DataFrame:
        """(a, null, links) for the links that the products of the groups don't count."""
        side = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"{x}_group"))
        new = light.join(side("a"), "a", "left").join(side("b"), "b", "left").where("a_group IS NULL OR b_group IS NULL OR a_group <> b_group")
        both = new.select("a", "b").unionByName(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        counted = both.join(wanted.select(F.col("node").alias("b"), "copies"), "b")
        return counted.groupBy("a").agg(F.sum("copies").alias("links")).select("a", F.lit(None).cast("long").alias("b"), "links")

    def counted_links(self) -> DataFrame:
        """Rows (a, b, 0), links that connect every component, and rows (a, null, links): the sum of
        these for a node is the number of documents of other sets that its documents link with."""
        pairs = common.checkpoint(self._candidates())
        groups = common.checkpoint(self._heavy_groups())
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(groups.select("node")).distinct()
        wanted = common.checkpoint(wanted.join(self.nodes.select("node", "doc_id", "fp", "copies"), "node"))
        own = self._sets_of(wanted)
        found = common.checkpoint(self._light_links(pairs, wanted, own).withColumn("links", F.lit(0).cast("long")).unionByName(self._heavy_links(groups, wanted, own).withColumn("heavy", F.lit(True)), allowMissingColumns=True))
        light = found.where("heavy IS NULL").select("a", "b")
        return found.drop("heavy").unionByName(self._light_counts(light, groups, wanted))


def classes(docs: DataFrame, n: int = NGRAM, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id of each document, and n_links, the number of other documents (rows) it links with."""
    join = Join(docs, n, share)
    found = join.counted_links()
    member = graph.components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = join.nodes.select("node", "fp", "doc_id", "copies").join(member, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(least, "component").select("fp", "component_id", "n_links")
    signed = join.signed().withColumnRenamed("n", "n_shingles")
    return signed.join(by_set, "fp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, n: int = NGRAM, share: int = SHARE) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with its own columns.
    Rows of one doc_id are one document; of them one row stays. Texts are not
    shuffled while what goes is small enough to be broadcast."""
    names = docs.columns
    own = [x if x in ("doc_id", "text") else f"c{k}" for k, x in enumerate(names)]
    docs = docs.toDF(*own)
    found = common.checkpoint(classes(docs, n, share).select("doc_id", "component_id"))
    per = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    per = common.checkpoint(per.where("rows > 1 OR NOT stays").select(F.col("doc_id").alias("__id"), "rows", "stays"))
    small = per.count() <= BROADCAST_ROWS
    side = lambda df: F.broadcast(df) if small else df
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    once = docs.join(side(per.select("__id")), same, "left_anti")
    repeated = per.where("stays").select("__id")
    if repeated.isEmpty():
        return once.toDF(*names)
    return once.unionByName(docs.join(side(repeated), same, "left_semi").dropDuplicates(["doc_id"])).toDF(*names)
