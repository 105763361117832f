"""Periodic runs of words, by bit-parallel lags.

The words of a document are numbered, and the numbers' bits are big integers, one
plane for each bit, one place for each word. Words q apart are compared for the
whole document at once: each plane is XORed with itself shifted by q, and the
results are ORed, so a zero marks two identical words. ANDs of the zeros with
themselves, shifted by doubling distances, leave the starts of stretches of at
least max(least, times q) - q zeros, which are the runs of period q. Planes are
added one by one, and a lag ends as soon as no long stretch is left.

A run of a multiple of its smallest period has the same place as one found at a
shorter lag and is left out. Lags of FILTERED words and more are tried only where a
run can be: of two windows of Q words (a power of two, Q <= q < 2 Q), one at a multiple of Q and one q
later, every run of period q holds an equal pair, and window hashes of all places
follow by doubling. Pairs inside a run of a period of at most Q, which can't belong to
another smallest period, are skipped. So long texts cost n log n, and n / 64 for each lag with a run.

One pass, nothing is shuffled; a text is one task's work, as runs may span all of it. Its
words take about nine times its bytes.

Defined cases: a null or empty text has no words and no runs; repeated rows each
get their row; a null doc_id is kept; other columns are ignored by ``find`` and
kept by ``collapse_texts``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A run has at least LEAST words and TIMES periods.
LEAST = 6
TIMES = 4
#: From this lag on, lags are tried only where equal windows suggest them; a power of two.
FILTERED = 64

RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Edit = Callable[[int | None, list[bytes]], list[bytes]]


def planes(ids: np.ndarray) -> list[int]:
    """A big integer for each bit of the numbers, bit i for word i."""
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max()).bit_length()))]


def long_stretches(ones: int, least: int) -> int:
    """The places from which at least ``least`` ones follow."""
    size = 1
    while ones and size < least:
        step = min(size, least - size)
        ones &= ones >> step
        size += step
    return ones


def places(bits: int) -> list[int]:
    """The places of the ones, ascending."""
    if bits.bit_count() > 8:
        raw = np.frombuffer(bits.to_bytes(bits.bit_length() + 7 >> 3, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def lags(ids: np.ndarray, most: int, found: list[tuple[int, int, int]]) -> Iterator[int]:
    """Lags from FILTERED to ``most``, ascending, at which there can be a run that is not in ``found``, which grows meanwhile."""
    n, size = len(ids), 1
    h = common.mix(ids.astype(np.uint64) + np.uint64(1))
    while size <= most:
        if size >= FILTERED:
            grid = h[::size]
            later = np.zeros((len(grid) + 1) * size, np.uint64)
            later[: len(h) - size] = h[size:]
            k, step = np.nonzero(later.reshape(-1, size)[: len(grid)] == grid[:, None])
            q = size + step
            # how far the runs of periods of at most ``size`` that start at or before a place reach
            reach = np.zeros(n, np.int64)
            for start, length, period in found:
                if period <= size:
                    reach[start] = max(reach[start], start + length)
            reach = np.maximum.accumulate(reach)
            yield from np.unique(q[(q <= most) & (k * size + q + size > reach[k * size])]).tolist()
        h = common.mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:])
        size *= 2


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of a sequence of numbers, by start, then period."""
    if times < 2:
        raise ValueError("a run has at least two periods")
    n = len(ids)
    if n < least:
        return []
    own, found, seen = planes(ids), [], set()
    most = n // times

    def every() -> Iterator[int]:
        # the filter needs runs of at least three periods
        yield from range(1, min(most, FILTERED - 1 if times > 2 else most) + 1)
        if times > 2:
            yield from lags(ids, most, found)

    for q in every():
        need = max(least, times * q) - q
        whole = (1 << n - q) - 1
        wrong = 0
        for plane in own:
            wrong |= plane ^ plane >> q
            hits = long_stretches(wrong & whole ^ whole, need)
            if not hits:
                break
        for start, last in zip(places(hits & ~(hits << 1)), places(hits & ~(hits >> 1))):
            length = last - start + need + q
            if (start, length) not in seen:
                seen.add((start, length))
                found.append((start, length, q))
        if (0, n) in seen:
            break  # a longer period inside a run over all words is never a smallest one
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: all but those of a run after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def strongest(found: list[tuple[int, int, int]]) -> dict[str, int] | None:
    """The run of the greatest length / period, compared exactly; ties: least start, then period."""
    best = None
    for start, length, period in found:
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return dict(zip(("start", "length", "period"), best)) if best else None


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for the same bytes."""
    ids = dict.fromkeys(words)
    for k, w in enumerate(ids):
        ids[w] = k
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES, edit: Edit | None = None, key: str = "doc_id") -> DataFrame:
    """The key, ``runs`` (start, length, period) by start and period, ``best``, the strongest of
    them, and ``text``, the words that stay, joined by one space. Words are ``[^\\x20\\x09-\\x0D]+``; ``edit``
    may change the words of a key first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch):
                every, best, texts = [], [], []
                for doc, raw in zip(part.column(key).to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    words = (raw or b"").split()  # bytes are split at just this white space
                    if edit:
                        words = edit(doc, words)
                    found = runs(numbered(words), least, times) if words else []
                    if found:
                        words = compress(words, kept(len(words), found).tolist())
                    every.append(found)
                    best.append(strongest(found))
                    texts.append(b" ".join(words))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in every]))).astype(np.int32)
                flat = np.array([r for x in every for r in x], np.int64).reshape(-1, 3)
                rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(offsets, rows), pa.array(best, _RUN), pa.array(texts, pa.binary()).view(pa.string())], names=[key, "runs", "best", "text"])

    rows = common.text_column(docs, key, "text")
    return rows.mapInArrow(common.task(run), f"{key} {rows.schema[key].dataType.simpleString()}, runs array<{RUN}>, best {RUN}, text string")


def _line(r: Column) -> Column:
    return F.concat(F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]), F.lit("\n"))


def digests(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, n_runs, the strongest run, and the digests of all runs and of the collapsed text."""
    best = F.col("best")
    return find(docs, edit=edit).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[x].alias(x) for x in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", _line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )


def collapse_texts(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The documents with every run cut to its first period. Texts without runs stay as they are; n_chars, where there is one, is set anew."""
    names = docs.columns
    own = ["text" if x == "text" else f"c{k}" for k, x in enumerate(names)]
    held = docs.toDF(*own).select(F.struct(*[x for x in own if x != "text"]).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch):
                texts, changed = part.column("text").cast(pa.binary()).to_pylist(), []
                for k, raw in enumerate(texts):
                    words = (raw or b"").split()
                    found = runs(numbered(words), least, times) if words else []
                    changed.append(bool(found))
                    if found:
                        texts[k] = b" ".join(compress(words, kept(len(words), found).tolist()))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.binary()).view(pa.string()), pa.array(changed)], names=["row", "text", "changed"])

    common.bounded_batches(docs.sparkSession)
    found = held.mapInArrow(common.task(run), f"row {held.schema['row'].dataType.simpleString()}, text string, changed boolean")
    out = []
    for name, x in zip(names, own):
        value = F.col("text" if x == "text" else f"row.{x}")
        if name == "n_chars":
            value = F.when(F.col("changed"), F.length("text")).otherwise(value).cast(docs.schema[name].dataType)
        out.append(value.alias(name))
    return found.select(*out)
