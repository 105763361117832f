"""Fill-in-the-middle rewriting of documents, cut at lines by rank and select.

The lines of a chunk of texts are a packed bit vector, a one at the last byte of
each line, with the number of ones before each block of 512 bits (``Bits``). The
rank of a text's end less that of its start is its number of lines n; the cuts
after line a and line b are selects of the ranks a and b beyond the text's start.
A second vector, a one at the first byte of each code point, gives lengths in
code points as differences of ranks. Cuts come from digests of the seed and
doc_id, so a text is rewritten the same way in any order and on any machine.

One pass, nothing is shuffled; all texts of a chunk are cut at once.

Defined cases: a null or empty text is kept as it is (form plain, n = 0, null as
empty); so is one that holds a mark; a null doc_id counts as the word null;
repeated rows each get their row, the same one; other columns are ignored by
``transform`` and kept by ``rewrite``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Hundredths of the documents that are rewritten, and of these, those in suffix-prefix-middle order.
RATE = 100
SPM_RATE = 50

#: Bits of a word and words of a block of the directory.
_WORD = 64
_BLOCK = 8


class Bits:
    """A packed bit vector with the count of ones before each block."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        size = _WORD // 8 * _BLOCK
        self.words = np.pad(packed, (0, -len(packed) % size + size)).view("<u8")  # one empty block at the end
        ones = np.bitwise_count(self.words).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))
        self.total = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each place."""
        block, rest = np.divmod(np.asarray(at, np.int64), _WORD * _BLOCK)
        out = self.before[block].copy()
        for k in range(_BLOCK):
            left = np.clip(rest - k * _WORD, 0, _WORD)
            mask = np.where(left == _WORD, ~np.uint64(0), (np.uint64(1) << np.minimum(left, _WORD - 1).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(self.words[block * _BLOCK + k] & mask)
        return out

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The place of the rank-th one, counted from 1."""
        rank = np.asarray(rank, np.int64)
        block = np.searchsorted(self.before, rank, side="left") - 1
        left = rank - self.before[block]
        word, open_ = block * _BLOCK, np.ones(len(rank), bool)
        for _ in range(_BLOCK - 1):
            ones = np.bitwise_count(self.words[word]).astype(np.int64)
            open_ &= left > ones
            left -= np.where(open_, ones, 0)
            word += open_
        value, at = self.words[word], word * _WORD
        half = _WORD // 2
        while half:
            low = value & ((np.uint64(1) << np.uint64(half)) - np.uint64(1))
            ones = np.bitwise_count(low).astype(np.int64)
            high = left > ones
            left -= np.where(high, ones, 0)
            at += np.where(high, half, 0)
            value = np.where(high, value >> np.uint64(half), low)
            half //= 2
        return at


class Cuts(NamedTuple):
    """Of each text: lines, where prefix and middle end (bytes from the start of the data), their code points."""

    n: np.ndarray
    prefix_end: np.ndarray
    middle_end: np.ndarray
    prefix_chars: np.ndarray
    middle_chars: np.ndarray


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> Cuts:
    """Cuts of the texts at ``offsets`` after the smaller and the larger of h1 and h2, modulo lines + 1, lines."""
    ends = data == 10
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    lines, points = Bits(ends), Bits((data & 0xC0) != 0x80)
    base = lines.rank(offsets)
    n = np.diff(base)
    a, b = h1 % (n + 1), h2 % (n + 1)

    def place(line: np.ndarray) -> np.ndarray:
        out, some = offsets[:-1].copy(), np.flatnonzero(line)
        out[some] = lines.select(base[some] + line[some]) + 1
        return out

    p, m = place(np.minimum(a, b)), place(np.maximum(a, b))
    rank = points.rank(np.concatenate((offsets[:-1], p, m))).reshape(3, -1)
    return Cuts(n, p, m, rank[1] - rank[0], rank[2] - rank[1])


def draws(doc_id: int | str | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the digest of the seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The key and the columns in ``keep``, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output."""
    marks = (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode())
    pre, suf, mid = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch):
                data, offsets = common.utf8(part.column("text"))
                h = np.array([draws(x, seed) for x in part.column(key).to_pylist()], np.int64).reshape(-1, 4)
                cut = cuts(data, offsets, h[:, 0], h[:, 1])
                raw = data.tobytes()
                forms, outputs = [], []
                for k, (start, p, m, end) in enumerate(zip(offsets[:-1].tolist(), cut.prefix_end.tolist(), cut.middle_end.tolist(), offsets[1:].tolist())):
                    text = raw[start:end]
                    if not text or any(x in text for x in marks) or h[k, 2] % 100 >= rate:
                        forms.append("plain")
                        outputs.append(text)
                    elif h[k, 3] % 100 < spm_rate:
                        forms.append("spm")
                        outputs.append(b"".join((suf, raw[m:end], pre, raw[start:p], mid, raw[p:m])))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((pre, raw[start:p], suf, raw[m:end], mid, raw[p:m])))
                plain = np.array([x == "plain" for x in forms], bool)
                columns = [pa.array(cut.n), pa.array(forms), pa.array(cut.prefix_chars, mask=plain), pa.array(cut.middle_chars, mask=plain), pa.array(outputs, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in (key, *keep)), *columns], names=[key, *keep, "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = common.text_column(docs, key, *keep, "text")
    own = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in (key, *keep))
    return rows.mapInArrow(common.task(run), f"{own}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. Rewritten texts hold no mark, and no mark can begin inside
    another, so the marks are those that were put there."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix, suffix = (F.when(form == "psm", F.get(parts, F.lit(k))).otherwise(F.get(parts, F.lit(3 - k))) for k in (1, 2))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of what it restores to."""
    sha = lambda x: F.sha2(x, 256)
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def rewrite(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The documents with their texts rewritten; n_chars, where there is one, is set anew. A null text stays null."""
    names = docs.columns
    own = [x if x in ("doc_id", "text") else f"c{k}" for k, x in enumerate(names)]
    rows = docs.toDF(*own).withColumn("missing", F.col("text").isNull())
    made = transform(rows, seed, rate, spm_rate, "doc_id", (*[x for x in own if x not in ("doc_id", "text")], "missing"))
    text = F.when(~F.col("missing"), F.col("output"))
    out = []
    for name, x in zip(names, own):
        value = text if x == "text" else F.col(x)
        if name == "n_chars":
            value = F.when(F.col("form") != "plain", F.length("output")).otherwise(value).cast(docs.schema[name].dataType)
        out.append(value.alias(name))
    return made.select(*out)
