"""Dataset records as JSON Lines: three kinds in one file, in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ROUTE, SCHEMA_VERSION, SHADOW, UNRESOLVED, USAGE, Vocabulary

KIND_RANK = {"usage": 0, "shadow-component": 1, "unresolved-dynamic": 2}


def _label(c: str, v: Vocabulary) -> Column:
    col = F.col(c)
    for x in ("ds", "direct-ds", "ds-backed-wrapper", "ds-composition"):
        col = F.when(F.col(c) == x, v.label(x)).otherwise(col)
    return col


def usage_value(v: Vocabulary = Vocabulary()) -> Column:
    """A usage as a JSON object; absent fields are left out."""
    fields = {
        "schemaVersion": F.lit(SCHEMA_VERSION), "kind": F.lit("usage"), "repoId": F.col("repo_id"), "filePath": F.col("file_path"), "line": F.col("line"), "column": F.col("col"),
        "componentName": F.col("component_name"), "category": _label("category", v), "bucket": F.col("bucket"), "shadowLevel": F.col("shadow_level"),
        "classificationSource": _label("classification_source", v), v.field("ds_package"): F.col("ds_package"), "canonicalizedVia": F.col("canonicalized_via"),
        "localLibId": F.col("local_lib_id"), v.field("ds_backed_by_lib"): F.col("ds_backed_by_lib"), "route": F.col("route"), "resolution": F.coalesce("resolution", F.lit("static")),
    }
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def shadow_value(v: Vocabulary = Vocabulary()) -> Column:
    """A shadow component as a JSON object; the slots feature, candidate mapping and embedding are written as null."""
    keep = {"ignoreNullFields": "false"}
    null = F.lit(None).cast("string")
    # nulls are explicit in all of this record, which has no absent fields
    fields = {
        "schemaVersion": F.lit(SCHEMA_VERSION), "kind": F.lit("shadow-component"), "repoId": F.col("repo_id"), "filePath": F.col("file_path"), "componentName": F.col("component_name"),
        "signature": F.struct(F.col("prop_names").alias("propNames"), F.col("jsx_element_count").alias("jsxElementCount"), F.col("local_imports").alias("localImports"), F.col("ds_imports").alias(v.field("ds_imports")), F.col("html_tags").alias("htmlTags"), F.col("uses_styled").alias("usesStyled")),
        "pathHint": F.struct(F.col("directory_segments").alias("directorySegments"), F.col("feature")),
        "codeSnippet": F.col("code_snippet"), "codeSnippetTruncated": F.col("code_snippet_truncated"),
        v.field("ds_candidate_mapping"): F.struct(null.alias("candidatePackage"), null.alias("candidateComponent"), F.lit(None).cast("double").alias("confidence"), null.alias("source")),
        "embedding": F.lit(None).cast("array<double>"), "usageCount": F.col("usage_count"), "filesUsedIn": F.col("files_used_in"), "shadowLevel": F.col("shadow_level"), "signals": F.col("signals"),
    }
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), keep)


def unresolved_value() -> Column:
    fields = {"schemaVersion": F.lit(SCHEMA_VERSION), "kind": F.lit("unresolved-dynamic"), "repoId": F.col("repo_id"), "filePath": F.col("file_path"), "line": F.col("line"), "reason": F.col("reason"), "context": F.substring("context", 1, 80)}
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def usage_json(usage: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    return usage.select(usage_value(v).alias("value"))


def ordered_json(usage: DataFrame, shadow: DataFrame, unresolved: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """All records as JSON in the total order: repo, file, kind, line, column, component."""
    zero, none = F.lit(0), F.lit("")

    def keyed(df: DataFrame, value: Column, rank: int, line: Column, col: Column, name: Column) -> DataFrame:
        return df.select(value.alias("value"), F.col("repo_id").alias("k0"), F.col("file_path").alias("k1"), F.lit(rank).alias("k2"), line.alias("k3"), col.alias("k4"), name.alias("k5"))

    every = keyed(usage, usage_value(v), KIND_RANK["usage"], F.col("line"), F.col("col"), F.col("component_name"))
    every = every.unionByName(keyed(shadow, shadow_value(v), KIND_RANK["shadow-component"], zero, zero, F.col("component_name")))
    every = every.unionByName(keyed(unresolved, unresolved_value(), KIND_RANK["unresolved-dynamic"], F.col("line"), zero, none))
    return every.orderBy("k0", "k1", "k2", "k3", "k4", "k5", "value").select("value")


#: Records of a compressed file, which one task reads.
FILE_RECORDS = 1_000_000


def write_lines(lines: DataFrame, path: str) -> None:
    """Records (``value``) as a folder of compressed text files, in no order, to be read back by ``read_jsonl``. The names of the fields are most of a record, so what
    is written is a small part of the text."""
    lines.select("value").write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def write_jsonl(usage: DataFrame, shadow: DataFrame, unresolved: DataFrame, path: str, v: Vocabulary = Vocabulary(), single: bool = True) -> None:
    """A folder of text files; ``single``: one file, as the dataset is exchanged. For large scans write Parquet and leave it False: the order runs through the files."""
    out = ordered_json(usage, shadow, unresolved, v)
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def _wide(v: Vocabulary) -> T.StructType:
    s, i, b = T.StringType(), T.IntegerType(), T.BooleanType()
    a = T.ArrayType(s)
    signature = T.StructType([T.StructField("propNames", a), T.StructField("jsxElementCount", i), T.StructField("localImports", a), T.StructField(v.field("ds_imports"), a), T.StructField("htmlTags", a), T.StructField("usesStyled", b)])
    hint = T.StructType([T.StructField("directorySegments", a), T.StructField("feature", s)])
    kinds = {"schemaVersion": s, "kind": s, "repoId": s, "filePath": s, "line": i, "column": i, "componentName": s, "category": s, "bucket": s, "shadowLevel": s, "classificationSource": s, v.field("ds_package"): s, "canonicalizedVia": s, "localLibId": s, v.field("ds_backed_by_lib"): b, "route": ROUTE, "resolution": s, "signature": signature, "pathHint": hint, "codeSnippet": s, "codeSnippetTruncated": b, "usageCount": T.LongType(), "filesUsedIn": T.LongType(), "signals": a, "reason": s, "context": s}
    return T.StructType([T.StructField(k, t) for k, t in kinds.items()])


def variants(lines: DataFrame) -> DataFrame:
    """(kind, repo_id, file_path, record, value) of lines (``value``) of all kinds of records, whatever fields they have: ``record`` is a VARIANT.
    A line that is no JSON object with a kind has a null kind and keeps its text; blank lines are skipped."""
    read = lines.where(F.trim("value") != "").select("value", F.try_parse_json("value").alias("record"))
    field = lambda x: F.try_variant_get("record", f"$.{x}", "string")
    return read.select(field("kind").alias("kind"), field("repoId").alias("repo_id"), field("filePath").alias("file_path"), "record", "value")


def elements(documents: DataFrame, path: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each element of an array inside JSON documents (``value``), with the fields (path and type) that are asked for, and ``place``, its place there.
    Documents that are malformed or lack the array give no rows."""
    arrays = documents.select(F.try_variant_get(F.try_parse_json("value"), path, "array<variant>").alias("items"))
    each = arrays.select(F.posexplode("items").alias("place", "item"))
    return each.select("place", *[F.try_variant_get("item", at, kind).alias(name) for name, (at, kind) in fields.items()])


def read_jsonl(spark: SparkSession, path: str, v: Vocabulary = Vocabulary()) -> dict[str, DataFrame]:
    """The three kinds of records, by ``usage``, ``shadow`` and ``unresolved``, and all as ``records``. Blank lines are skipped."""
    rows = spark.read.schema(_wide(v)).json(path)
    neutral = lambda c: F.when(F.col(c) == v.name, "ds").when(F.col(c) == f"direct-{v.name}", "direct-ds").when(F.col(c) == f"{v.name}-backed-wrapper", "ds-backed-wrapper").when(F.col(c) == f"{v.name}-composition", "ds-composition").otherwise(F.col(c))
    u = rows.where("kind = 'usage'").select(
        F.col("repoId").alias("repo_id"), F.col("filePath").alias("file_path"), "line", F.col("column").alias("col"), F.col("componentName").alias("component_name"), neutral("category").alias("category"), "bucket",
        F.col("shadowLevel").alias("shadow_level"), neutral("classificationSource").alias("classification_source"), F.col(v.field("ds_package")).alias("ds_package"), F.col("canonicalizedVia").alias("canonicalized_via"),
        F.col("localLibId").alias("local_lib_id"), F.col(v.field("ds_backed_by_lib")).alias("ds_backed_by_lib"), "route", "resolution",
    )
    g = F.col("signature")
    s = rows.where("kind = 'shadow-component'").select(
        F.col("repoId").alias("repo_id"), F.col("filePath").alias("file_path"), F.col("componentName").alias("component_name"), g["propNames"].alias("prop_names"), g["jsxElementCount"].alias("jsx_element_count"),
        g["localImports"].alias("local_imports"), g[v.field("ds_imports")].alias("ds_imports"), g["htmlTags"].alias("html_tags"), g["usesStyled"].alias("uses_styled"), F.col("pathHint.directorySegments").alias("directory_segments"),
        F.col("pathHint.feature").alias("feature"), F.col("codeSnippet").alias("code_snippet"), F.col("codeSnippetTruncated").alias("code_snippet_truncated"), F.col("usageCount").alias("usage_count"), F.col("filesUsedIn").alias("files_used_in"),
        F.col("shadowLevel").alias("shadow_level"), "signals",
    )
    x = rows.where("kind = 'unresolved-dynamic'").select(F.col("repoId").alias("repo_id"), F.col("filePath").alias("file_path"), "line", "reason", "context")
    return {"usage": u, "shadow": s, "unresolved": x, "records": rows}


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {"usage": spark.createDataFrame([], USAGE), "shadow": spark.createDataFrame([], SHADOW), "unresolved": spark.createDataFrame([], UNRESOLVED)}
