"""An extension beyond the batch scan: adoption kept up to date as dataset files arrive.

JSON Lines files dropped into a folder are read as a stream; counts by repo are
kept as streaming state, whose size is the number of repos. A restart goes on
from its checkpoint; a file is counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X

_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "repoId", "bucket")])


def adoption_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """repo_id, adoption, shadow, value; for output mode ``complete`` or ``update``."""
    rows = spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    usage = rows.where("kind = 'usage'")
    counts = usage.groupBy(F.col("repoId").alias("repo_id")).agg(F.count_if(F.col("bucket") == "adoption").alias("adoption"), F.count_if(F.col("bucket") == "shadow").alias("shadow"))
    return counts.withColumn("value", X.ratio(F.col("adoption"), F.col("adoption") + F.col("shadow")))


def scan_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each repo's adoption between two scans; missing sides count as absent."""
    a, b = (df.select("repo_id", F.col("value").alias(n)) for df, n in ((before, "before"), (after, "after")))
    return a.join(b, "repo_id", "full").withColumn("delta", F.col("after") - F.col("before"))
