"""Periodic runs, fill-in-the-middle and line deduplication against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kitmeter.llm import common, lines, middle, queries, runs


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def write_documents(spark, folder, rows):
    """A documents table with columns that clash with names the operators use."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, n long, runs string, h string"
    data = [(k, t, "en", "s", None if t is None else len(t), 5, "clash", "clash") for k, t in rows]
    spark.createDataFrame(data, kinds).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


# --- periodic runs


def brute_runs(words, least=6, times=4):
    """Every maximal stretch of every period, kept if no smaller number is a period of it."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(least, times * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, letters, parts):
    """Random words with stretches of several periods between them."""
    out = []
    for _ in range(parts):
        out += [rng.choice(letters) for _ in range(rng.randint(0, 6))]
        root = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 70, 130]))]
        size = int(len(root) * rng.uniform(2, 6))
        out += (root * 7)[:size]
    return out


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefghijklmnop"])
def test_runs_by_definition(letters):
    rng = random.Random(5)
    for k in range(60):
        words = periodic(rng, letters, rng.randint(0, 5)) if k % 2 else [rng.choice(letters) for _ in range(rng.randint(0, 90))]
        ids = runs.numbered([w.encode() for w in words])
        got = runs.runs(ids) if len(ids) else []
        assert got == brute_runs(words)


def test_runs_of_long_periods_and_other_bounds():
    """Periods on both sides of the powers of two from which lags are filtered, at any offset, nested runs inside."""
    rng = random.Random(6)
    for q in (63, 64, 65, 127, 128, 129, 200, 255, 256, 257):
        root = [rng.randrange(1000) for _ in range(q)]
        root[3:15] = [7] * 12
        for offset in (0, 1, 37, 64, 100):
            ids = np.array([rng.randrange(1000, 2000) for _ in range(offset)] + (root * 5)[: 4 * q + rng.randint(0, 5)] + [2500, 2501])
            assert runs.runs(ids) == brute_runs(ids.tolist())
    for times in (2, 3) * 20:
        ids = np.array([rng.randrange(3) for _ in range(40)])
        assert runs.runs(ids, 4, times) == brute_runs(ids.tolist(), 4, times)
    square = np.array([*range(200), *range(200)])
    assert runs.runs(square, 6, 2) == [(0, 400, 200)]


def test_long_texts_of_runs():
    """Long texts of one word, of a long period, and without any run."""
    rng = np.random.default_rng(1)
    assert runs.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    root = rng.integers(0, 1 << 20, 5000)
    assert (50_000, 200_000, 5000) in runs.runs(np.concatenate((rng.integers(1 << 20, 1 << 21, 50_000), np.tile(root, 40))))
    half = np.concatenate((np.zeros(150_000, np.int64), np.arange(1, 150_001)))
    assert runs.runs(half) == [(0, 150_000, 1)]


def repeating(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def run_rows():
    rng = random.Random(7)
    rows = [(k, " ".join(periodic(rng, "abcde", 3))) for k in range(60)]
    rows += [(k, " ".join(rng.choice(["uno", "dos x", "três", "\U0001f600"]) + rng.choice([" ", "\n", "\t\r\x0b\x0c"]) for _ in range(rng.randint(0, 200)))) for k in range(60, 110)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one"), (204, "a " * 3000), (3, rows[3][1]), (None, "b b b b b b b c"), (None, None), (-5, "x y x y x y x y")]
    return rows


def test_periodic_runs_query(spark, tmp_path):
    rows = run_rows()
    got = queries.queries()["op11_periodic_runs"](spark, write_documents(spark, tmp_path, rows))
    want = []
    for k, t in rows:
        words = repeating(k, re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        found = brute_runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = None
        for s, n, q in found:
            if best is None or n * best[2] > best[1] * q or n * best[2] == best[1] * q and (s, q) < (best[0], best[2]):
                best = (s, n, q)
        own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((k, len(found), *own, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 30


def test_collapsed_texts(spark):
    rows = [(1, "a b c", 5, "r"), (2, "x x x x x x y", 13, "r"), (3, None, None, None), (4, "", 0, "")]
    df = spark.createDataFrame(rows, "row long, text string, n_chars long, changed string")
    out = runs.collapse_texts(df)
    assert out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect())) == [(1, "a b c", 5, "r"), (2, "x y", 3, "r"), (3, None, None, None), (4, "", 0, "")]
    assert runs.collapse_texts(df.limit(0)).collect() == [] and runs.find(df.limit(0), key="row").collect() == []


# --- fill-in-the-middle


@pytest.mark.parametrize("density", [0, 0.001, 0.03, 0.5, 1])
def test_rank_and_select(density):
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        flags = rng.random(n) < density
        bits = middle.Bits(flags)
        ones = np.flatnonzero(flags)
        assert bits.total == len(ones)
        assert bits.rank(np.arange(n + 1)).tolist() == np.concatenate(([0], np.cumsum(flags))).tolist()
        assert bits.select(np.arange(1, len(ones) + 1)).tolist() == ones.tolist()


def middle_rows():
    rng = random.Random(8)
    pieces = ["\n", "\n\n", "word", "é", "\U0001f600", " ", "<", "<S", "S>", "\r\n", " ", "日本"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 60)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "a<P>b\nc"), (204, "<M>"), (205, "x\n<S>"), (206, "line\n" * 20_000), (5, rows[5][1]), (None, "a\nb\nc\n"), (-7, "a\nb")]
    return rows


def middle_by_definition(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text):
        return doc_id, n, "plain", None, None, text or ""
    if h4 % 100 < 50:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_query(spark, tmp_path):
    rows = middle_rows()
    got = queries.queries()["op12_fill_in_middle"](spark, write_documents(spark, tmp_path, rows))
    want = [(*made[:5], sha(made[5]), sha(t or "")) for (k, t) in rows for made in [middle_by_definition(k, t)]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_rewritten_documents(spark):
    rows = [(k, t, None if t is None else len(t), "x") for k, t in middle_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, form string")
    out = middle.rewrite(df)
    assert out.dtypes == df.dtypes
    want = [(k, None if t is None else middle_by_definition(k, t)[5], n if t is None else len(middle_by_definition(k, t)[5]), "x") for k, t, n, _ in rows]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert middle.rewrite(df, rate=0).exceptAll(df).count() == 0
    assert middle.transform(df.limit(0)).collect() == []


# --- lines


def strip(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def lines_by_definition(rows, least=10):
    """The lines that stay of each row."""
    order = lambda k: (k is None, k or 0)
    holders = {}
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(strip(line)) >= least:
                holders.setdefault(strip(line), set()).add(k)
    first = {x: min(ks, key=order) for x, ks in holders.items() if len(ks) > 1}
    return [(k, [line for line in (t or "").split("\n") if first.get(strip(line), k) == k], len((t or "").split("\n"))) for k, t in rows]


def line_rows():
    rng = random.Random(9)
    pool = [f"a line that is number {k}" for k in range(40)] + ["ÉÉÉÉÉÉÉÉÉÉ", "éééééééééé", "short", "", "exactly 10", "123456789"]
    form = lambda x: rng.choice(["", " ", "\t\r"]) + rng.choice([x, x.upper() if x.isascii() else x]) + rng.choice(["", "  ", "\x0b\x0c"])
    rows = [(k, "\n".join(form(rng.choice(pool)) for _ in range(rng.randint(1, 12)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (4, rows[4][1]), (4, "another text of four\n" + pool[0]), (None, pool[1]), (None, "a line of null only\n" + pool[2]), (None, "a line of null only\n" + pool[2])]
    rows += [(300, "\n".join(pool * 200)), (-3, pool[5]), (301, "a line of 301 only\na line of 301 only\n"), (302, " a line of 301 only")]
    return rows


def test_line_dedup_query(spark, tmp_path):
    rows = line_rows()
    got = queries.queries()["op13_line_dedup"](spark, write_documents(spark, tmp_path, rows))
    want = [(k, n, n - len(own), sha("\n".join(own))) for k, own, n in lines_by_definition(rows)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_deduplicated_documents(spark):
    rows = [(k, t, None if t is None else len(t), 1) for k, t in line_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, keep long")
    out = lines.deduplicate(df)
    assert out.dtypes == df.dtypes
    want = []
    for (k, own, n), (_, t, size, _) in zip(lines_by_definition([r[:2] for r in rows]), rows):
        cut = "\n".join(own)
        want.append((k, cut, len(cut), 1) if len(own) < n else (k, t, size, 1))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert lines.deduplicate(df.limit(0)).collect() == [] and lines.bitmaps(df.limit(0)).collect() == []


def test_one_line_in_all_documents(spark):
    """A line, and a document, far larger than the others."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same line for all\nown line number "), "id").alias("text"))
    big = spark.createDataFrame([(5000, "the same line for all\n" * 30_000 + "end of the big text")], "doc_id long, text string")
    found = by_id(lines.digests(df.unionByName(big)))
    assert found[0]["n_dropped"] == 0 and all(found[k]["n_dropped"] == 1 for k in range(1, 3000))
    assert found[5000]["n_dropped"] == 30_000 and found[5000]["kept_sha256"] == sha("end of the big text")


@pytest.mark.parametrize("places", [[0], [5], [0, 1, 2], [1, 3, 4, 9], [*range(0, 3000, 2)], [130, 131, 20_000, 3_000_000], [*range(200, 40_000)]])
def test_bitmaps_of_lines(spark, places):
    df = spark.createDataFrame([(places,)], "p array<int>").select(lines.encode(F.col("p")).alias("b"))
    sizes = df.select(lines.decode(F.col("b"))).first()[0]
    assert len(sizes) % 2 == 0
    at, got = 0, []
    for k, n in enumerate(sizes):
        if k % 2:
            got += range(at, at + n)
        at += n
    assert got == places
    # a byte or more for each run, of whatever length
    assert len(df.first()[0]) <= 2 * sum((n.bit_length() + 6) // 7 or 1 for n in sizes)


def test_chunks_are_cut_together():
    texts = [t for _, t in middle_rows()]
    data, offsets = common.utf8(pa.array(texts))
    h = np.arange(len(texts)) * 7
    cut = middle.cuts(data, offsets, h, h + 3)
    assert cut.n.tolist() == [len(re.findall(r"[^\n]*\n|[^\n]+", t or "")) for t in texts]
