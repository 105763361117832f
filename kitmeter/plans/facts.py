"""Facts of source files as rows: parsing in Python workers, a file a row. Only extracted rows leave them."""

from __future__ import annotations

import sys
from collections.abc import Collection, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..extract.facts import Facts

#: Calls that may be open at once in a worker that parses.
NESTING = 100_000
#: Files whose facts are held at once.
FILES = 500

_PROFILE = "struct<symbol:string,prop_names:array<string>,code_snippet:string,code_snippet_truncated:boolean,jsx_element_count:int,html_tags:array<string>,tags:array<string>,customized:array<string>,wrapped:array<string>,uses_styled:boolean>"
FACTS = f"repo_id string, file string, abs_path string, code string, message string, bindings array<struct<local:string,source:string,imported:string,is_namespace:boolean>>, elements array<struct<tag:string,base:string,line:int,col:int,ord:int>>, profiles array<{_PROFILE}>, named array<struct<source:string,local:string,exported:string,ord:int>>, stars array<struct<source:string,exported:string,ord:int>>, references array<string>, constants array<struct<name:string,member:string,kind:string,text:string,ord:int>>, own array<string>, local_exports array<struct<local:string,exported:string,ord:int>>, sites int, routes array<struct<node:int,parent:int,path:struct<kind:string,text:string>,page:string,names:array<string>>>"


_LISTS = ("bindings", "elements", "profiles", "named", "stars", "references", "constants", "own", "local_exports", "routes")


def _row(repo: str, file: str, path: str | None, snippet_lines: int, source: str | None, message: str | None) -> dict[str, Any]:
    row: dict[str, Any] = {"repo_id": repo, "file": file, "abs_path": path, "code": None, "message": None, "sites": 0} | {k: [] for k in _LISTS}
    if source is None:
        return row | {"code": "file-read-failed", "message": message}
    try:
        x = Facts(source, file.endswith(("tsx", "jsx")), snippet_lines)
    except (SyntaxError, RecursionError) as e:
        return row | {"code": "parse-failed", "message": str(e)[:200]}
    exports = [{"local": a, "exported": b, "ord": k} for (a, b), k in zip(x.local_exports, x.local_orders)]
    traced = {"constants": x.constant_rows(), "own": sorted(set(x.own)), "local_exports": exports, "sites": len(x.sites), "routes": x.route_rows()}
    return row | traced | {"bindings": [{"local": k, "source": s, "imported": i, "is_namespace": n} for k, (s, i, n) in x.bindings.items()], "elements": x.elements, "profiles": x.profiles, "named": x.named, "stars": x.stars, "references": sorted(set(x.references))}


def facts_of(sources: DataFrame, snippet_lines: int = 50, only: Collection[str] | None = None) -> DataFrame:
    """One row for each file: its facts, or a warning's code and message. ``sources``: repo_id, file, source, and, where there are, abs_path and
    message, why a null source could not be read. ``only``: the columns that are wanted, as Spark can't tell a Python step which they are."""
    optional = [F.col(x) if x in sources.columns else F.lit(None).cast("string").alias(x) for x in ("abs_path", "message")]

    columns = StructType([x for x in StructType.fromDDL(FACTS) if only is None or x.name in only])
    schema = to_arrow_schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # nested groups are read by calls of Python functions, whose frames lie on the heap
        sys.setrecursionlimit(max(sys.getrecursionlimit(), NESTING))
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                part = zip(*(c.to_pylist() for c in batch.slice(at, FILES).columns))
                yield pa.RecordBatch.from_pylist([_row(r, f, p, snippet_lines, s, m) for r, f, s, p, m in part], schema=schema)

    return sources.select("repo_id", "file", "source", *optional).mapInArrow(run, columns)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that files are made from or named by, dealt by keys over all cores: a small table of them may be one partition and yet hours of parsing."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def specifiers(facts: DataFrame) -> DataFrame:
    """(repo_id, file, source): the distinct module specifiers of each file."""
    every = F.concat(F.transform("bindings", lambda b: b["source"]), F.transform("named", lambda n: n["source"]), F.transform("stars", lambda s: s["source"]), F.col("references"))
    return facts.select("repo_id", "file", F.explode(F.array_distinct(every)).alias("source"))
