"""Secret scans, DataFrame and SQL functions only.

Three kinds are found by their form (the base): assignments, access keys and
hex strings. The method adds spans of kind ``entropy``: every candidate string
is read with a sliding window for its character class (hex or base64), whose
Shannon entropy follows from counts that are updated as one character enters and
one leaves; windows above the class's threshold are joined into a span. An
allow-list suppresses what is random-looking but harmless. Base spans always
stay; an entropy span that meets one is not repeated.

Only rows that hold a candidate are looked at closely. Nothing is shuffled.

Places are code points, the end exclusive. They are the lengths of the pieces
between matches added up, so no position function is needed.

Texts of any length: no expression repeats a group unless possessively, so the
regular expression engine's stack does not grow with a text; the counts of a
window are a few packed numbers, so a character costs the same in any candidate;
and lists of matches are walked in blocks of the root of their length (``walk``),
so n matches cost n^1.5 copies of a number, not n^2 of a match.

Defined cases: a null or empty text has no spans; repeated rows each get their
row; other columns are ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Base kinds in their order, with the least length of what must be long enough.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Candidate strings of the method: whole runs of at least 20 characters with a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

#: Character classes: expression of the whole candidate, window (at most 30), least entropy in bits.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 16, 2.9), ("base64", r"^[A-Za-z0-9+/_=-]+$", 20, 3.7))

#: Harmless strings: parts, and whole forms (words joined by separators, numbers, UUIDs, sequences).
ALLOW_PARTS = ("EXAMPLE", "example", "0123456789", "abcdefgh", "ABCDEFGH", "sha256-", "sha512-")
ALLOW_FORMS = (
    r"^[A-Za-z]*[0-9]{0,4}$",
    r"^[0-9+/_=-]+$",
    r"^([A-Za-z]+[0-9]{0,4}[/_=+-]+)+[A-Za-z]*[0-9]{0,4}$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",
)
#: The same form for an engine that backtracks by recursion: nothing that is taken is given back.
_POSSESSIVE = {ALLOW_FORMS[2]: r"^(?:[A-Za-z]++[0-9]{0,4}+[/_=+-]++)++[A-Za-z]*+[0-9]{0,4}+$"}

SPAN = "struct<start:int,kind:int,name:string,end:int>"
_KINDS = ("assign", "access", "hex", "entropy")

#: c*log2(c) is held in steps of 2^-40, so that a window's sum is exact however far it slides.
_SCALE = 1 << 40
#: Counts of five bits, twelve to a number.
_PACKED = 12
_ALPHABETS = {"hex": "0123456789abcdefABCDEF", "base64": string.digits + string.ascii_letters + "+/_=-"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def walk(items: Column, state: int, step: Callable[[Column, Column], Column]) -> Column:
    """The states (integers) after each item of an array: ``step(state, item)`` gives the next.
    They are gathered block by block, as what is gathered is copied at each step."""
    last = lambda out: F.element_at(out, -1)
    rest = lambda out: F.slice(out, F.lit(2), F.size(out))
    # the first of a block's states is the one before it

    def one(done: Column, block: Column) -> Column:
        before = F.array(last(last(done)))
        return F.concat(done, F.array(F.aggregate(block, before, lambda out, item: F.concat(out, F.array(step(last(out), item).cast("int"))))))

    start = F.array(F.array(F.lit(state).cast("int")))
    whole = F.aggregate(blocks(items), start, one, lambda done: F.flatten(F.transform(rest(done), rest)))
    return F.coalesce(whole, F.array().cast("array<int>"))


def blocks(items: Column) -> Column:
    """An array cut into runs of the root of its length; null for an empty one."""
    length = F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / length).cast("int")), lambda k: F.slice(items, k * length + 1, length)))


def _spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern in order as (start, end, string)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(found: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, s: F.length(g) + F.length(s))
        return F.zip_with(let(sizes, lambda x: walk(x, 0, lambda at, n: at + n)), found, lambda end, s: F.struct((end - F.length(s)).alias("start"), end.alias("end"), s.alias("string")))

    return let(found, placed)


def _kept(spans: Column, keep, kind: str) -> Column:
    number = _KINDS.index(kind)
    return F.transform(F.filter(spans, keep), lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), F.lit(kind).alias("name"), x["end"].alias("end"))).cast(f"array<{SPAN}>")


def _allowed(s: Column) -> Column:
    out = F.lit(False)
    for x in ALLOW_PARTS:
        out = out | s.contains(x)
    for x in ALLOW_FORMS:
        out = out | s.rlike(_POSSESSIVE.get(x, x))
    return out


def high_entropy(s: Column, alphabet: str, window: int, threshold: float) -> Column:
    """struct(first, last): the first start and the last end of windows of at least
    ``threshold`` bits in a string of characters of an alphabet, or null. State: packed counts
    by character, and the sum of c*log2(c), both changed by what enters and what leaves."""
    if window > 30:
        raise ValueError("counts are packed in five bits")
    most = math.floor((math.log2(window) - threshold) * window * _SCALE)
    weight = [round(c * math.log2(c) * _SCALE) if c else 0 for c in range(window + 2)]
    more = F.array(*[F.lit(weight[c + 1] - weight[c]) for c in range(window + 1)])
    less = F.array(F.lit(0).cast("long"), *[F.lit(weight[c] - weight[c - 1]) for c in range(1, window + 1)])
    numbers = -(-len(alphabet) // _PACKED)
    # where a character is counted: number, shift, one of it; what leaves before the first window is at an empty place
    places = {ord(x): (k // _PACKED, k % _PACKED * 5, 1 << k % _PACKED * 5) for k, x in enumerate(alphabet)}
    place = lambda at, shift, one: F.struct(F.lit(at).alias("at"), F.lit(shift).alias("shift"), F.lit(one).cast("long").alias("one"))
    nowhere = place(0, 5 * _PACKED, 0)
    table = F.array(*[place(*places[c]) if c in places else nowhere for c in range(128)])

    def count(a: Column, x: Column) -> Column:
        return F.call_function("shiftright", F.get(a["n"], x["at"]), x["shift"]).bitwiseAND(F.lit(31)).cast("int")

    def high(a: Column) -> Column:
        return (a["i"] >= window) & (a["sum"] <= most)

    def step(a: Column, m: Column) -> Column:
        x, y = m["x"], m["y"]
        n = F.transform(a["n"], lambda v, j: v + F.when(j == x["at"], x["one"]).otherwise(0) - F.when(j == y["at"], y["one"]).otherwise(0))
        changed = a["sum"] + F.get(more, count(a, x)) - F.get(less, count(a, y))
        same = (x["one"] == y["one"]) & (x["at"] == y["at"])
        # the window before this character is judged here, the last one at the end
        return F.struct(n.alias("n"), F.when(same, a["sum"]).otherwise(changed).alias("sum"), (a["i"] + 1).alias("i"), F.when((a["first"] < 0) & high(a), a["i"] - window).otherwise(a["first"]).alias("first"), F.when(high(a), a["i"]).otherwise(a["last"]).alias("last"))

    def found(a: Column) -> Column:
        first = F.when((a["first"] < 0) & high(a), a["i"] - window).otherwise(a["first"])
        return F.when(first >= 0, F.struct(first.alias("first"), F.when(high(a), a["i"]).otherwise(a["last"]).alias("last")))

    def whole(entering: Column) -> Column:
        leaving = F.concat(F.array_repeat(nowhere, window), F.slice(entering, F.lit(1), F.size(entering) - window))
        moves = F.zip_with(entering, leaving, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), numbers).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.aggregate(moves, start, step, found)

    return F.when(F.length(s) >= window, let(F.transform(F.split(s, ""), lambda c: F.get(table, F.ascii(c))), whole))


def _entropy_spans(text: Column) -> Column:
    found = F.filter(_spans(text, CANDIDATE), lambda x: x["string"].rlike("[0-9]") & ~_allowed(x["string"]))

    def judged(x: Column) -> Column:
        out = F.lit(None).cast("struct<first:int,last:int>")
        for name, form, window, threshold in reversed(CLASSES):
            out = F.when(x["string"].rlike(form), high_entropy(x["string"], _ALPHABETS[name], window, threshold)).otherwise(out)
        return F.struct(x["start"].alias("at"), out.alias("hit"))

    hits = F.filter(F.transform(found, judged), lambda x: x["hit"].isNotNull())
    return F.transform(hits, lambda x: F.struct((x["at"] + x["hit"]["first"]).alias("start"), F.lit(3).alias("kind"), F.lit("entropy").alias("name"), (x["at"] + x["hit"]["last"]).alias("end"))).cast(f"array<{SPAN}>")


def _free(spans: Column) -> Column:
    """Spans in order without the entropy spans that meet another one: a base span that starts
    before ends later (seen forwards), or one that starts after starts inside (seen backwards)."""
    entropy = lambda x: x["kind"] == 3
    ended = walk(spans, 0, lambda end, x: F.when(entropy(x), end).otherwise(F.greatest(end, x["end"])))
    started = F.reverse(let(F.reverse(spans), lambda back: walk(back, (1 << 31) - 1, lambda start, x: F.when(entropy(x), start).otherwise(x["start"]))))
    around = F.zip_with(ended, started, lambda a, b: F.struct(a.alias("ended"), b.alias("started")))
    seen = F.zip_with(spans, around, lambda x, a: F.struct(x.alias("span"), (entropy(x) & ((a["ended"] > x["start"]) | (a["started"] < x["end"]))).alias("met")))
    return F.transform(F.filter(seen, lambda x: ~x["met"]), lambda x: x["span"])


def with_spans(docs: DataFrame, text: str = "text", base: str = "__base", spans: str = "__spans") -> DataFrame:
    """Adds two columns, arrays of (start, kind, name, end) in order: the base spans, and all spans."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    # cheap gates first: most texts hold none of the marks
    gate = {
        "assign": (t.contains("=") | t.contains(":")) & t.rlike(ASSIGN),
        "access": t.contains("AKIA"),
        "hex": t.rlike("[0-9a-f]{32}"),
        "entropy": t.rlike(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20}"),
    }
    long_enough = {
        "assign": lambda x: F.length(F.regexp_extract(x["string"], ASSIGN, 2)) >= LEAST["assign"],
        "access": lambda x: F.length(x["string"]) >= LEAST["access"],
        "hex": lambda x: F.length(x["string"]) >= LEAST["hex"],
    }
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    # a shorter match of the hex class can't be kept and takes nothing from a longer one: runs are disjoint
    pattern["hex"] = r"(?<![0-9a-f])[0-9a-f]{32,}"
    found = [F.when(gate[k], _kept(_spans(t, pattern[k]), long_enough[k], k)).otherwise(none) for k in ("assign", "access", "hex")]
    df = docs.withColumn(base, F.sort_array(F.concat(*found)))
    df = df.withColumn(spans, F.when(gate["entropy"], _entropy_spans(t)).otherwise(none))
    every = F.sort_array(F.concat(base, spans))
    both = (F.size(base) > 0) & (F.size(spans) > 0)
    return df.withColumn(spans, F.when(both, let(every, _free)).otherwise(every))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_entropy."""
    df = with_spans(common.text_column(docs, "doc_id", "text"))
    count = lambda k: F.size(F.filter("__spans", lambda x: x["name"] == k)).cast("long")
    return df.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(_joined("__base"), 256).alias("base_sha256"), _joined("__spans").alias("spans"), count("entropy").alias("n_entropy"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span (joined where they overlap) replaced by ``mark``;
    n_chars, where there is one, is set to the new length. Texts without spans stay as they are."""
    names = docs.columns
    own = [f"c{k}" for k in range(len(names))]
    text = own[names.index("text")]
    df = with_spans(docs.toDF(*own), text, "base", "spans")
    t = F.col(text)

    def pieces(ends: Column) -> Column:
        """What stays before each span; a span that starts inside earlier ones adds nothing."""
        before = F.zip_with(F.concat(F.array(F.lit(0)), ends), "spans", lambda at, x: F.struct(at.alias("at"), x["start"].alias("start")))
        before = F.slice(before, F.lit(1), F.size("spans"))

        def cut(block: Column) -> Column:
            # places are counted in the short string of a block
            base = F.get(block, F.lit(0))["at"]
            part = F.substr(t, base + 1, F.greatest(F.lit(0), F.element_at(block, -1)["start"] - base))
            piece = lambda own, x: F.when(x["start"] < x["at"], F.lit("")).otherwise(F.concat(F.substr(own, x["at"] - base + 1, x["start"] - x["at"]), F.lit(mark)))
            return let(part, lambda own: F.array_join(F.transform(block, lambda x: piece(own, x)), ""))

        head = let(before, lambda x: F.array_join(F.transform(blocks(x), cut), ""))
        return F.concat(head, F.substr(t, F.element_at(ends, -1) + 1, F.length(t)))

    changed = F.size("spans") > 0
    ends = walk(F.col("spans"), 0, lambda at, x: F.greatest(at, x["end"]))
    new = F.when(changed, let(ends, pieces)).otherwise(t)
    out = df.withColumn("new", new)
    if "n_chars" in names:
        n = own[names.index("n_chars")]
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(n, F.when(changed, F.length("new")).otherwise(F.col(n)).cast(kind))
    return out.withColumn(text, F.col("new")).select(*own).toDF(*names)
