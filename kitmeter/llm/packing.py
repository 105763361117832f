"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Each document is its token ids followed by one end id. Only documents longer
than a sequence are cut, into full sequences; the remainder comes first. Full
pieces are sequences of their own at once. The others are dealt evenly into groups
of about GROUP pieces, by a hash of all that tells them apart, and packed group by
group: a bin is filled greedily with the largest piece that fits; then its
smallest piece is replaced by the two unpacked pieces that fit the widened gap
most tightly, where these fill the bin better. The packer works on a histogram of
lengths, so a group costs O(pieces + lengths^2) whatever its order.

Only lengths are shuffled, never tokens. The number of groups follows the number
of pieces, so a group's size is bounded whatever ids repeat or are null. Each group
leaves at most a few bins partly empty; ``fill`` reports sequences against the
least possible number.

Tokenisation is that of the tokenizers file of byte_bpe_50k without special tokens
added; the string of a special token in a text is that token, as the file says.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed once each; the empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import os
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEQUENCE = 2048
END_ID = 0
GROUP = 20_000


#: Characters whose classes a worker keeps.
_KEPT = 1 << 18


class Tokenizer:
    """Token ids of texts as little-endian unsigned 32-bit numbers, by a tokenizers file. The default file comes
    with the same vocabulary as ranks, by which tiktoken gives the same ids several times as fast. Texts with a special
    token, or with a character that editions of Unicode may class differently, are given to the file, and so are all texts of
    another file."""

    def __init__(self, vocabulary: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores, not the threads of one
        import public_tokenizers
        from tokenizers import Tokenizer as File

        self._file = File.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        self._ranked = self._by_ranks() if vocabulary is None else None
        self._special = [x.content for x in self._file.get_added_tokens_decoder().values()]
        self._plain: dict[str, bool] = {}

    @staticmethod
    def _by_ranks() -> Callable[[str], list[int]]:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _is_plain(self, text: str) -> bool:
        if len(self._plain) > _KEPT:
            self._plain = {}
        for c in set(text):
            known = self._plain.get(c)
            if known is None:
                old, new = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
                known = self._plain[c] = c in "\t\n\r" or old[0] == new[0] and (old[0] in "LPS" or old == new == "Nd" or c == " ")
            if not known:
                return False
        return not any(x in text for x in self._special)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._ranked is not None and self._is_plain(x) for x in texts]
        whole = iter(self._file.encode_batch_fast([x for x, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [array("I", self._ranked(text) if p else next(whole).ids).tobytes() for text, p in zip(texts, plain)]


def tokenizer(vocabulary: str | None = None) -> Tokenizer:
    """One for each worker process and vocabulary, until the worker serves another operator."""
    found = common.kept("packing")
    if vocabulary not in found:
        found[vocabulary] = Tokenizer(vocabulary)
    return found[vocabulary]


def pieces_of(ids: bytes, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of these ids, its end id included."""
    n = len(ids) // 4
    lead = n % limit or limit
    return [(0, min(lead, n))] + [(s, limit) for s in range(lead, n, limit)]


def tokenised(docs: DataFrame, limit: int = SEQUENCE, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; with_ids: and its ids."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for batch in batches:
            for part in common.chunks(batch):
                rows: list[list] = [[], [], [], [], [], []]
                texts = [x or "" for x in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), t.encode(texts)):
                    ids += end
                    for k, (start, length) in enumerate(pieces_of(ids, limit)):
                        own = ids[4 * start : 4 * (start + length)]
                        for column, x in zip(rows, (doc, k, start, length, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None)):
                            column.append(x)
                arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(rows[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return common.text_column(docs, "doc_id", "text").mapInArrow(common.task(run, "packing"), schema)


def best_two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each length (1 to limit)."""
    stock: list[list[int]] = [[] for _ in range(limit + 1)]
    for k in range(len(lengths) - 1, -1, -1):
        stock[lengths[k]].append(k)
    there = 0  # bit g: a piece of length g is in stock
    for g in range(1, limit + 1):
        there |= bool(stock[g]) << g
    upto = [(2 << g) - 1 for g in range(limit + 1)]

    def largest(g: int) -> int:
        """The largest length in stock of at most g, or 0."""
        return max(0, (there & upto[g]).bit_length() - 1) if g > 0 else 0

    def take(g: int) -> int:
        nonlocal there
        k = stock[g].pop()
        if not stock[g]:
            there &= ~(1 << g)
        return k

    def tightest_pair(gap: int) -> tuple[int, int]:
        """Two lengths in stock with the largest sum of at most gap."""
        best, pair = 0, (0, 0)
        a = largest(gap - 1)
        while a and 2 * a > best and best < gap:
            b = largest(min(gap - a, a))
            if b == a and len(stock[a]) < 2:
                b = largest(a - 1)
            if b and a + b > best:
                best, pair = a + b, (a, b)
            a = largest(a - 1)
        return pair

    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while there:
        inside, gap = [], limit
        while x := largest(gap):
            inside.append(take(x))
            gap -= x
        if gap and len(inside) > 1:
            smallest = int(lengths[inside[-1]])
            a, b = tightest_pair(gap + smallest)
            if a + b > smallest:
                stock[smallest].append(inside.pop())
                there |= 1 << smallest
                inside += [take(a), take(b)]
        at = 0
        for k in inside:
            bins[k], offsets[k] = number, at
            at += int(lengths[k])
        number += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, limit: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length. Pieces are written to the checkpoint
    folder first, so that each keeps its number."""
    columns = pieces.columns
    kept = common.checkpoint(pieces.withColumn("__n", F.monotonically_increasing_id()))
    groups = max(1, math.ceil(kept.where(F.col("length") < limit).count() / group))
    dealt = kept.where(F.col("length") < limit).withColumn("__g", F.pmod(F.xxhash64("__n"), F.lit(groups)).cast("int"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__n", kind="stable", ignore_index=True)
        bins, offsets = best_two_fit(part["length"].to_numpy(), limit)
        part["sequence_id"] = (np.int64(key[0]) << 32) + bins
        part["offset"] = offsets
        return part[[*columns, "sequence_id", "offset"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    packed = dealt.groupBy("__g").applyInPandas(run, f"{kinds}, sequence_id long, offset long")
    # a full piece is a sequence of its own, with a negative number
    full = kept.where(F.col("length") == limit).select(*columns, (-1 - F.col("__n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack(docs: DataFrame, limit: int = SEQUENCE, vocabulary: str | None = None, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    return pack_pieces(tokenised(docs, limit, vocabulary), limit, group)


def sequences(docs: DataFrame, limit: int = SEQUENCE, vocabulary: str | None = None, group: int = GROUP) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids. Ids are gathered a sequence at a time, at most ``limit``."""
    packed = pack_pieces(tokenised(docs, limit, vocabulary, with_ids=True), limit, group)
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("x")).select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"))


def fill(packed: DataFrame, limit: int = SEQUENCE) -> DataFrame:
    """One row: sequences, and least, the number that no packing of these lengths can go below."""
    return packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.ceil(F.coalesce(F.sum("length"), F.lit(0)) / limit).alias("least"))
