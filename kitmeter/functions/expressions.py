"""Scalar expressions: tag names, package names, paths, globs, keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_native_tag(tag: Column) -> Column:
    """The first character has a case and is lower: ``div``, ``motion.div``; not ``_X``."""
    first = F.substring(tag, 1, 1)
    return (first == F.lower(first)) & (first != F.upper(first))


def is_component_name(name: Column) -> Column:
    first = F.substring(name, 1, 1)
    return (name == "default") | ((first == F.upper(first)) & (first != F.lower(first)))


def base_name(tag: Column) -> Column:
    """The leftmost identifier of a dotted or namespaced tag."""
    return F.regexp_extract(tag, "^([^.:]*)", 1)


def last_segment(tag: Column) -> Column:
    return F.substring_index(tag, ".", -1)


def package_name(specifier: Column) -> Column:
    """``@s/p/x`` as ``@s/p``, ``p/x`` as ``p``; a bare scope as it is."""
    found = F.regexp_extract(specifier, "^(@[^/]*/[^/]*|[^/]+)", 1)
    return F.when(found == "", specifier).otherwise(found)


def repo_id(name: Column, url: Column) -> Column:
    """The given name, else the last part of the URL without ``.git``, else the URL."""
    last = F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/:]+)$", 1), r"\.git$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(last, F.lit("")), url)


def directory_segments(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def dirname(path: Column) -> Column:
    """The folder of a path; '' for a name without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def normal_path(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty segments; '' for the root, ``..`` first where it leaves the root."""
    up = lambda done: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(F.lit(".."))))
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def feature(path: Column) -> Column:
    """The first segment after a segment ``features``, or null."""
    segments = directory_segments(path)
    at = F.array_position(segments, "features")
    return F.when((at > 0) & (at < F.size(segments)), F.get(segments, at.cast("int")))


def join_path(parent: Column, path: Column) -> Column:
    """A child route's path under its parent's."""
    plain = F.regexp_replace(parent, "/$", "")
    return F.when(path.isNull(), parent).when(path == "", F.when(parent == "", F.lit("/")).otherwise(parent)).when(path.startswith("/"), path).otherwise(F.concat(plain, F.lit("/"), path))


def parallel_layer(path: Column) -> Column:
    """A segment ``ui`` or ``kit``, in any case (``components/ui`` and ``shared/ui`` are such)."""
    return F.arrays_overlap(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), F.array(F.lit("ui"), F.lit("kit")))


def element_bucket(n: Column) -> Column:
    return F.when(n <= 2, "0-2").when(n <= 4, "3-4").when(n <= 9, "5-9").when(n <= 19, "10-19").otherwise("20+")


def group_key(name: Column, props: Column, elements: Column) -> Column:
    """First 16 hex digits of the SHA-256 of name, props and size bucket."""
    return F.substring(F.sha2(F.concat_ws("|", name, F.array_join(props, ","), element_bucket(elements)), 256), 1, 16)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for 0 / 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def level_rank(level: Column) -> Column:
    return F.when(level == "confirmed", 3).when(level == "likely", 2).when(level == "possible", 1).otherwise(0)


def level_of_rank(rank: Column) -> Column:
    return F.when(rank == 3, "confirmed").when(rank == 2, "likely").when(rank == 1, "possible")


def glob_to_regex(glob: str, dot: bool = False) -> str:
    """An anchored regex for a glob: ``*``, ``**``, ``?``, ``[..]``, ``{a,b}``; without ``dot`` wildcards meet no leading dot."""
    guard = "" if dot else r"(?!\.)"
    out, i, depth = "", 0, 0
    start = True  # at the beginning of a segment
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and start and (i + 2 == len(glob) or glob[i + 2] == "/"):
            if i + 2 == len(glob):
                out += f"(?:{guard}[^/]+(?:/{guard}[^/]+)*)?"
                i += 2
            else:
                out += f"(?:{guard}[^/]+/)*"
                i += 3
            continue
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            whole = start and (i + 1 == len(glob) or glob[i + 1] == "/")
            out += (guard if start else "") + ("[^/]+" if whole else "[^/]*")
        elif c == "?":
            out += (guard if start else "") + "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{" and "}" in glob[i:]:
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        start = c == "/" or (start and c in "{,")
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str], dot: bool = False) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_to_regex(g, dot))
    return out
