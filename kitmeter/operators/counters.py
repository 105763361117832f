"""Cross-file counters: usages of each component, counted once for its canonical profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X


def usage_counters(pending: DataFrame, aliases: DataFrame) -> DataFrame:
    """profile_id, usage_count, files_used_in. ``pending``: repo_id, def_file, symbol,
    importer; ``aliases``: repo_id, def_file, symbol, profile_id. Keys are turned into
    profiles first, so alias keys of one profile are one group."""
    keyed = pending.join(aliases, ["repo_id", "def_file", "symbol"])
    return keyed.groupBy("profile_id").agg(F.count("*").alias("usage_count"), F.countDistinct("importer").alias("files_used_in"))


def key_counters(pending: DataFrame) -> DataFrame:
    """The same by (def_file, symbol), without aliases."""
    return pending.groupBy("repo_id", "def_file", "symbol").agg(F.count("*").alias("usage_count"), F.countDistinct("importer").alias("files_used_in"))


def synthetic_shadows(pending: DataFrame) -> DataFrame:
    """Library usages without a profile: one possible shadow for each key; the first usage in order names it."""
    first = F.min_by(F.struct("component_name", "file_path", "local_lib_id"), F.struct("file_ord", "site_ord"))
    found = pending.groupBy("repo_id", "def_file", "symbol").agg(F.count("*").alias("usage_count"), first.alias("f"))
    return found.select("repo_id", "def_file", "symbol", "f.*", "usage_count", F.lit(1).cast("long").alias("files_used_in"), F.lit("possible").alias("shadow_level"))


def shadow_rows(judged: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Shadow components of a dataset: judged profiles that are shadows and in use, and synthetic ones, with the hints of their paths."""
    hint = {"directory_segments": X.directory_segments(F.col("file_path")), "feature": X.feature(F.col("file_path"))}
    own = judged.where("bucket = 'shadow' AND usage_count > 0")
    return own.withColumns(hint).select(*columns).unionByName(synthetic.withColumns(hint).select(*columns))
