"""PII: base patterns, and information-theoretic sanitisation of revealing terms.

Base entities (e-mail, IP, card, phone) are found by their form. Protected are each value and its class (of an
e-mail its domain, else any of its kind), as most values occur once, and what points at any card does so at each. The method
then asks the corpus how strongly other terms reveal an entity: for entity c and
term t in its context (CONTEXT words on either side) it counts the documents
with c, with t anywhere, and with t in the context of c. With N documents,

    PMI(c; t) = log2(N n(c,t) / (n(c) n(t))),   IC(c) = log2(N / n(c)),

and the disclosure PMI / IC is 1 for a term that occurs nowhere but beside c.
From REMOVE on a term is removed, from GENERALISE on it is replaced by what it is (``general``: a number, a code, a name, a word); either
adds a span of kind ``term`` wherever the term occurs in any document, with the
highest disclosure of its pairs. A pair needs SUPPORT documents, so what occurs
once reveals nothing. (Sanchez and Batet's C-sanitisation, with protected entities
found by their form.)

All documents are counted. Text is read three times: for entities and contexts,
for the frequencies of all words (each task adds up what it reads, and sums are
kept for the terms that pairs need), and for the places of the revealing terms, which
are sent in blocks of about BLOCK. Tasks send sums and places, never texts.

Defined cases: null is the empty text; repeated rows each count and get their
row; other columns are ignored by ``scan`` and kept by ``sanitise``. Places are
code points, the end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import common

CONTEXT = 8
SUPPORT = 3
#: Half of what it takes to tell the entity.
GENERALISE = 0.5
REMOVE = 0.9
BLOCK = 200_000
#: Words whose sums a task holds.
HELD = 1 << 20
#: Rows with revealing terms that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000

KINDS = ("email", "ip", "card", "phone")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: The words of ``common.ALNUM``, of any length.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = {65 + k: 97 + k for k in range(26)}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @: a match needs the run
    of local characters that ends at it, so no run is read twice."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() > 11 and 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def _key(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def entity(text: str, kind: int) -> int:
    """One number for each protected entity: its kind and its value, letters folded, of cards and phones the digits."""
    return _key(f"{kind}:{text.translate(_FOLD) if kind < 2 else re.sub('[^0-9]', '', text)}")


def classes(text: str, kind: int) -> int:
    """One number for the class that an entity belongs to, which is protected too: of an e-mail its domain, else its kind."""
    return _key(f"class:{kind}:{text.rpartition('@')[2].translate(_FOLD) if kind == 0 else ''}")


def outside(words: list[tuple], spans: list[tuple[int, int, int]]) -> list[tuple]:
    """The words, (start, end, ...) in order, that touch no span."""
    if not spans:
        return words
    edges = []  # spans joined where they overlap
    for s, _, e in spans:
        if edges and s < edges[-1][1]:
            edges[-1][1] = max(edges[-1][1], e)
        else:
            edges.append([s, e])
    out, k = [], 0
    for w in words:
        while k < len(edges) and edges[k][1] <= w[0]:
            k += 1
        if k == len(edges) or w[1] <= edges[k][0]:
            out.append(w)
    return out


#: What is protected of a span: its value, and its class.
PROTECTED = (entity, classes)


def contexts(text: str, spans: list[tuple[int, int, int]], protected: tuple = (entity,)) -> list[tuple[int, int, int, int]]:
    """(entity, term hash, start, end) of the CONTEXT nearest words on either side of each entity,
    however far; words in base spans are none."""
    if not spans:
        return []
    words = outside([m.span() for m in _WORD.finditer(text)], spans)
    begins = [a for a, _ in words]
    out = []
    for start, kind, end in spans:
        at = bisect.bisect_left(begins, start)
        near = range(max(0, at - CONTEXT), min(at + CONTEXT, len(words)))
        out += [(c, w) for c in [of(text[start:end], kind) for of in protected] for w in near]
    # each word is hashed once, however many entities stand beside it
    used = sorted({w for _, w in out if not text[slice(*words[w])].isdecimal()})
    if not used:
        return []
    data, offsets = common.utf8(pa.array([text[slice(*words[w])] for w in used], pa.string()))
    hashes = dict(zip(used, common.word_hashes(common.LOWER[data], offsets[:-1], offsets[1:]).view(np.int64).tolist()))
    return [(c, hashes[w], *words[w]) for c, w in out if w in hashes]


_PASS = "doc_id long, key binary, counts array<long>, base array<string>, pairs array<struct<c:long,t:long>>"


def _row_key(doc: int | None, text: str | None) -> bytes:
    """Joins what two passes find in a row; rows of one key are equal."""
    return xxhash.xxh3_128_digest(f"{doc}:{text or ''}".encode())


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.struct([("c", pa.int64()), ("t", pa.int64())])
    for batch in batches:
        for part in common.chunks(batch):
            keys, counts, base, pairs = [], [], [], []
            for doc, text in zip(part.column("doc_id").cast(pa.int64()).to_pylist(), part.column("text").to_pylist()):
                keys.append(_row_key(doc, text))
                spans = base_spans(text) if text else []
                own = [0, 0, 0, 0]
                for _, k, _ in spans:
                    own[k] += 1
                counts.append(own)
                base.append([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])
                own = {of(text[s:e], k) for s, k, e in spans for of in PROTECTED}
                pairs.append([{"c": c, "t": None} for c in own] + [{"c": c, "t": t} for c, t in {x[:2] for x in contexts(text, spans, PROTECTED)}] if spans else [])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.list_(pa.int64())), pa.array(base, pa.list_(pa.string())), pa.array(pairs, pa.list_(pair))], names=["doc_id", "key", "counts", "base", "pairs"])


def _frequencies(docs: DataFrame) -> DataFrame:
    """Documents that hold each word, over the whole table; a task sends its sums whenever it holds HELD words."""

    def sums(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        t, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return t, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in common.chunks(batch):
                data, offsets = common.utf8(part.column("text"))
                data = common.LOWER[data]
                starts, ends, counts = common.words(data, offsets, common.ALNUM)
                if not len(starts):
                    continue
                t, at = np.unique(common.word_hashes(data, starts, ends).view(np.int64), return_inverse=True)
                doc = np.repeat(np.arange(len(counts)), counts)
                once = np.unique(doc * len(t) + at) % len(t)
                held.append((t, np.bincount(once, minlength=len(t))))
                size += len(t)
                if size > HELD:
                    held = [sums(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["t", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums(held)], names=["t", "n"])

    return docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("nt"))


def _blocks(terms: DataFrame) -> Iterator[list]:
    """The rows of a table of distinct terms ``t``, sorted, in blocks of about BLOCK."""
    blocks = math.ceil(terms.count() / BLOCK)
    for k in range(blocks):
        own = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)
        found = sorted(own.collect(), key=lambda r: r["t"])
        if found:
            yield found


def _places(rows: DataFrame, terms: np.ndarray, disclosure: np.ndarray) -> DataFrame:
    """(key, terms) of the rows that hold any of the terms (sorted hashes), with each place outside base spans."""
    sent = rows.sparkSession.sparkContext.broadcast((terms, disclosure))
    place = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("disclosure", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, value = sent.value
        for batch in batches:
            for part in common.chunks(batch):
                data, offsets = common.utf8(part.column("text"))
                low = common.LOWER[data]
                starts, ends, counts = common.words(low, offsets, common.ALNUM)
                h = common.word_hashes(low, starts, ends).view(np.int64)
                at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                known = np.flatnonzero(own[at] == h)
                doc = np.repeat(np.arange(len(counts)), counts)[known]
                # code points before each byte
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                s, e = points[starts[known]] - points[offsets[doc]], points[ends[known]] - points[offsets[doc]]
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                keys, places = [], []
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)]):
                    k = int(doc[a])
                    text = part.column("text")[k].as_py()
                    free = outside(list(zip(s[a:b].tolist(), e[a:b].tolist(), value[at[known[a:b]]].tolist())), base_spans(text))
                    if free:
                        keys.append(_row_key(part.column("doc_id")[k].as_py(), text))
                        places.append([dict(zip(("s", "e", "disclosure"), x)) for x in free])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(places, pa.list_(place))], names=["key", "terms"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "key binary, terms array<struct<s:int,e:int,disclosure:double>>")


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(c, t, disclosure) of the pairs whose disclosure reaches GENERALISE."""
    n = found.count()
    pairs = found.select("__row", F.explode("pairs").alias("x")).select("__row", "x.c", "x.t")
    joint = pairs.where("t IS NOT NULL").distinct().groupBy("c", "t").agg(F.count("*").alias("nct")).where(F.col("nct") >= SUPPORT)
    alone = pairs.select("__row", "c").distinct().groupBy("c").agg(F.count("*").alias("nc"))
    joint = common.checkpoint(joint)
    if joint.isEmpty():
        return joint.select("c", "t", F.lit(0.0).alias("disclosure"))
    parts = _frequencies(docs)
    pmi = F.log2(F.lit(float(n)) * F.col("nct") / (F.col("nc") * F.col("nt")))
    ic = F.log2(F.lit(float(n)) / F.col("nc"))
    scored = joint.join(parts, "t").join(alone, "c").where(F.col("nc") < n).withColumn("disclosure", pmi / ic)
    return scored.where(F.col("disclosure") >= GENERALISE).select("c", "t", "disclosure")


def _found(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What the first pass finds in each row, and (key, terms) of the rows that hold revealing terms, if there are any."""
    found = common.checkpoint(rows.mapInArrow(_first_pass, _PASS).withColumn("__row", F.monotonically_increasing_id()))
    revealing = common.checkpoint(disclosures(rows, found).groupBy("t").agg(F.max("disclosure").alias("disclosure")))
    placed = None
    for block in _blocks(revealing):
        p = _places(rows, np.array([r["t"] for r in block], np.int64), np.array([r["disclosure"] for r in block]))
        placed = p if placed is None else placed.unionByName(p)
    if placed is None:
        return found, None
    # a row's places come from each block, and equal rows have them all
    return found, placed.groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"))


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base (strings kind:start:end) and terms, an array of (s, e, disclosure); one row for each document, and ``__row``."""
    found, placed = _found(common.text_column(docs, "doc_id", "text"))
    none = F.array().cast("array<struct<s:int,e:int,disclosure:double>>")
    if placed is None:
        return found.drop("pairs", "key").withColumn("terms", none)
    return found.drop("pairs").join(placed, "key", "left").drop("key").withColumn("terms", F.coalesce("terms", none))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_term."""
    df = detected(docs)
    at = lambda x: F.split(x, ":")[1].cast("int")
    keyed = F.concat(
        F.transform("base", lambda x, i: F.struct(at(x).alias("at"), i.alias("i"), x.alias("x"))),
        F.transform("terms", lambda t, i: F.struct(t["s"].alias("at"), (i + F.size("base")).alias("i"), F.concat_ws(":", F.lit("term"), t["s"].cast("string"), t["e"].cast("string")).alias("x"))),
    )
    spans = F.array_join(F.transform(F.array_sort(keyed), lambda k: k["x"]), ",")
    return df.select("doc_id", *[F.get("counts", k).alias(f"n_{x}") for k, x in enumerate(KINDS)], F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), spans.alias("spans"), F.size("terms").cast("long").alias("n_term"))


def general(term: str) -> str:
    """What a term is, for a reader: digits, digits among letters, a capital first, or none of these."""
    if term.isdigit():
        return "[NUMBER]"
    return "[CODE]" if _DIGIT.search(term) else "[NAME]" if term[:1].isupper() else "[WORD]"


def replaced(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, float]]) -> str:
    """Entities as their marks; terms generalised or removed."""
    cuts = [(s, e, MARKS[KINDS[k]]) for s, k, e in base]
    cuts += [(s, e, "" if d >= REMOVE else general(text[s:e])) for s, e, d in terms]
    out, free = [], 0
    for s, e, mark in sorted(cuts):
        if s >= free:
            out += [text[free:s], mark]
        free = max(free, e)
    return "".join(out) + text[free:]


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with entities replaced by their marks and revealing terms generalised or
    removed, each row by its own text; columns of any name stay. n_chars is not changed."""
    names = docs.columns
    own = [f"c{k}" for k in range(len(names))]
    doc, text = own[names.index("doc_id")], own[names.index("text")]
    df = docs.toDF(*own)
    rows = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    _, placed = _found(rows)
    schema = df.schema
    at = own.index(text)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, text):
                keys = [_row_key(d, t) for d, t in zip(part.column(doc).cast(pa.int64()).to_pylist(), part.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=[*own, "key"])

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, text):
                new = [t and replaced(t, base_spans(t), [(x["s"], x["e"], x["disclosure"]) for x in terms or []]) for t, terms in zip(part.column(text).to_pylist(), part.column("terms").to_pylist())]
                columns = [part.column(x) for x in own]
                columns[at] = pa.array(new, part.column(text).type)
                yield pa.RecordBatch.from_arrays(columns, names=own)

    if placed is None:
        known = df.withColumn("terms", F.lit(None).cast("array<struct<s:int,e:int,disclosure:double>>"))
    else:
        placed = common.checkpoint(placed)
        few = common.small(placed, BROADCAST_ROWS)
        known = df.mapInArrow(keyed, StructType([*schema.fields, StructField("key", BinaryType())])).join(F.broadcast(placed) if few else placed, "key", "left")
    return known.select(*own, "terms").mapInArrow(change, schema).toDF(*names)
