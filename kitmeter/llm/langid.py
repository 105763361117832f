"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte 2- and 3-grams of its lower-cased
letters, the text between two spaces, of length 1. Each language has several centroids, found by spherical
k-means among its training vectors; a text gets the language of the centroid of
the largest cosine, its score. Texts whose cosine is below what training texts
of that language reach are rejected (column ``rejected``); a text without
letters is ``und``.

The model is fitted on a sample of at most about SAMPLE labelled rows, dealt
evenly over the languages by a hash of doc_id; document frequencies for the IDF
are those of the sample too, as a part of the model. Every row is predicted from
its whole text. Nothing is shuffled; the model has a fixed size for each language.

Defined cases: null or empty text and text without letters: ``und``, score 0,
rejected; without any labelled row all are ``und``; of equal cosines the language first
in order, and its first centroid, wins; repeated rows each get their row; other columns are ignored by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bound of the training sample, of all languages together.
SAMPLE = 4000
CLUSTERS = 4
BITS = 13
DIMENSIONS = 1 << BITS
#: Rows whose dense vectors are held at a time.
ROWS = 64
ROUNDS = 12

#: Rejection: below this share of the cosine that all but QUANTILE of the training texts of a language reach.
QUANTILE = 0.002
MARGIN = 0.75
#: Texts of fewer n-grams reach less; their bound falls with the square root of the number.
FULL_LENGTH = 400

#: Bytes that are no letter as a space.
_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray


def counts(texts: pa.Array) -> np.ndarray:
    """Hashed n-gram counts, a row for each text."""
    space = pa.scalar(" ", texts.type)
    texts = pc.binary_join_element_wise(space, pc.utf8_lower(pc.fill_null(texts, "")), space, pa.scalar("", texts.type))
    data, offsets = common.utf8(texts)
    n = len(offsets) - 1
    b = _FOLDED[data].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * DIMENSIONS
    out = np.zeros(n * DIMENSIONS, np.int64)
    for size in (2, 3):
        if len(b) < size:
            continue
        m = len(b) - size + 1
        code = b[:m].copy()
        solid = b[:m] != 32
        for k in range(1, size):
            code = code << np.uint32(8) | b[k : k + m]
            solid |= b[k : k + m] != 32
        solid &= doc[:m] == doc[size - 1 :]
        code = (code[solid] * np.uint32(0x9E3779B1) ^ np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
        out += np.bincount(doc[:m][solid] + (code >> np.uint32(32 - BITS)).astype(np.int64), minlength=len(out))
    return out.reshape(n, DIMENSIONS)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1; a float32 argument is used up."""
    v = found.astype(np.float32, copy=False)
    np.log1p(v, out=v)
    v *= idf
    v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], 1e-9)
    return v


def spherical_kmeans(v: np.ndarray, k: int) -> np.ndarray:
    """Centroids of length 1, from a farthest-first start; the same for the same rows in any order of equal rows."""
    mean = v.mean(axis=0)
    chosen = [int(np.argmax(v @ mean))]
    best = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, v @ v[chosen[-1]])
    c = v[chosen].copy()
    for _ in range(ROUNDS):
        own = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].sum(axis=0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-9)
    return c


def eligible() -> Column:
    """Rows to learn from: crc32 of doc_id as text leaves a remainder by 5."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model | None:
    rows = common.text_column(docs, "doc_id", "text", "lang").where(eligible())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    each = max(1, sample // len(sizes))
    rate = F.lit(1.0)
    for x, n in sizes.items():
        rate = F.when(F.col("lang") == x, min(1.0, each / n)).otherwise(rate)
    draw = F.xxhash64(F.col("doc_id"), F.lit(7)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, rows=ROWS):
                found = counts(part.column("text"))
                at = [np.flatnonzero(x) for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("lang"), pa.array([x.astype("<u2").tobytes() for x in at], pa.binary()), pa.array([f[x].astype("<u4").tobytes() for f, x in zip(found, at)], pa.binary())], names=["doc_id", "lang", "at", "n"])

    drawn = rows.where(draw < rate).mapInArrow(common.task(run), "doc_id long, lang string, at binary, n binary").collect()
    drawn = sorted((r for r in drawn if r["at"]), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["at"], r["n"]))
    if not drawn:
        return None
    # rows stay sparse; only those of one language are made dense at a time
    seen = np.bincount(np.concatenate([np.frombuffer(r["at"], "<u2") for r in drawn]), minlength=DIMENSIONS)
    idf = np.log((1 + len(drawn)) / (1 + seen) + 1).astype(np.float32)
    languages = sorted({r["lang"] for r in drawn})
    parts, reach = [], []
    for x in languages:
        own = [r for r in drawn if r["lang"] == x]
        found = np.zeros((len(own), DIMENSIONS), np.float32)
        for row, r in zip(found, own):
            row[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u4")
        v = vectors(found, idf)
        parts.append(spherical_kmeans(v, clusters))
        reach.append(np.quantile((v @ parts[-1].T).max(axis=1), QUANTILE) * MARGIN)
        del v, found
    centroids = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return Model(languages, idf, centroids, owner, np.array(reach, np.float32))


def predict(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score, rejected of each text."""
    letters = np.array([bool(t) and next(filter(str.isalpha, t), "") != "" for t in texts.to_pylist()], bool)
    if model is None or not len(letters):
        return ["und"] * len(letters), np.zeros(len(letters)), np.ones(len(letters), bool)
    found = counts(texts)
    cosine = vectors(found, model.idf) @ model.centroids.T
    share = np.sqrt(np.minimum(1.0, found.sum(axis=1) / FULL_LENGTH))
    best = np.argmax(cosine, axis=1)
    score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0.0, 1.0)
    language = model.owner[best]
    rejected = ~letters | (score < model.floor[language] * share)
    names = [model.languages[k] if x else "und" for k, x in zip(language.tolist(), letters.tolist())]
    return names, np.where(letters, score, 0.0), rejected


def _identified(docs: DataFrame, model: Model | None, kept: list[str]) -> DataFrame:
    """Predictions, and the kept columns under numbers, as their names may clash with ours."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    rows = docs.select(F.col("doc_id"), F.col("text"), held_out().alias("held_out"), *[F.col(f"`{x}`").alias(f"__{k}") for k, x in enumerate(kept)])
    extra = [f for f in rows.schema if f.name.startswith("__")]
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, held_out boolean, lang_pred string, score double, rejected boolean" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, rows=ROWS):
                names, score, rejected = predict(sent.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected), *(part.column(f.name) for f in extra)], names=["doc_id", "held_out", "lang_pred", "score", "rejected", *(f.name for f in extra)])

    return rows.mapInArrow(common.task(run), schema)


def identify(docs: DataFrame, model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each document, and the columns in ``keep``."""
    kept = [x for x in keep or [] if x != "doc_id"]
    out = _identified(docs, model, kept)
    return out.withColumnsRenamed({f"__{k}": x for k, x in enumerate(kept)}) if kept else out


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    stays = _identified(docs, model, docs.columns).where(~F.col("rejected"))
    return stays.select(*[F.col(f"__{k}").alias(x) for k, x in enumerate(docs.columns)])
