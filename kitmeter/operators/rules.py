"""The rule cascade over usages (stage A) and component profiles (stage B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..schema import PRIMITIVES

REUSABLE_FILES = 2
SUBSTANTIAL_ELEMENTS = 5


def stage_a(usage: DataFrame) -> DataFrame:
    """Adds category, bucket, source and ``pending`` to usages joined with their binding.

    Needs: tag, source (of the binding, or null), resolved_kind (in-repo, external,
    unresolved), is_ds_package, lib_id, lib_backed. The first rule that holds decides.
    """
    bound = F.col("source").isNotNull()
    relative = F.col("source").rlike(r"^(\./|\.\./|/)")
    rule = (
        F.when(X.is_native_tag(F.col("tag")), 1)
        .when(bound & (F.col("resolved_kind") == "external") & F.coalesce(F.col("is_ds_package"), F.lit(False)), 2)
        .when(bound & F.col("lib_id").isNotNull() & F.coalesce(F.col("lib_backed"), F.lit(False)), 3)
        .when(bound & F.col("lib_id").isNotNull(), 4)
        .when(bound & (F.col("resolved_kind") == "in-repo"), 5)
        .when(bound & (F.col("resolved_kind") == "unresolved") & relative, 6)
        .when(bound, 7)
        .otherwise(8)
    )
    df = usage.withColumn("rule", rule)
    r = F.col("rule")
    return df.withColumns({
        "category": F.when(r == 1, "html-native").when(r == 2, "ds").when(r.isin(3, 4), "local-library").when(r == 7, "third-party").otherwise("local"),
        "bucket": F.when(r.isin(1, 7), "neither").when(r.isin(2, 3), "adoption"),
        "classification_source": F.when(r.isin(1, 7), "utility-heuristic").when(r == 2, "direct-ds").when(r == 3, "ds-backed-wrapper"),
        "ds_backed_by_lib": F.when(r == 3, True),
        "local_lib_id": F.when(r.isin(3, 4), F.col("lib_id")),
        "pending": r.isin(4, 5, 6, 8),
    })


def neither_code(name: Column, elements: Column) -> Column:
    """What makes a component neither adoption nor shadow by its name, or null."""
    return (
        F.when(name.rlike("(Provider|Context|Gate)$"), "provider-context")
        .when(name.rlike("^use[A-Z]"), "hook-like")
        .when(name.rlike("(Query|Mutation|Fetcher|Loader|Data)$") & (elements <= 2), "data-component")
        .when(name.rlike("(Layout|Page|Template|Shell|Scaffold)$") & (elements <= 3), "layout-wrapper")
        .when(name.rlike("(Container|Wrapper)$"), "business-container")
    )


def signals(primitives: Column | None = None, reusable: int = REUSABLE_FILES, substantial: int = SUBSTANTIAL_ELEMENTS) -> Column:
    """The shadow signals of a profile, in their fixed order."""
    names = primitives if primitives is not None else F.array(*map(F.lit, PRIMITIVES))
    marks = F.array(
        F.when(F.col("customizes_ds") | F.col("wraps_ds_with_styled"), "wraps-with-customization"),
        F.when(F.col("uses_styled") & ~F.col("has_ds_import"), "standalone-styled"),
        F.when(F.array_contains(names, F.col("component_name")), "primitive-like-name"),
        F.when(F.col("jsx_element_count") >= substantial, "substantial-markup"),
        F.when(F.col("files_used_in") >= reusable, "reusable-local"),
        F.when(X.parallel_layer(F.col("file_path")), "parallel-layer"),
    )
    return F.filter(marks, lambda x: x.isNotNull())


def level(has_ds: Column, found: Column) -> Column:
    """confirmed, likely or possible; null without signals."""
    has = lambda x: F.array_contains(found, x)
    return F.when(F.size(found) == 0, None).when(~has_ds & has("primitive-like-name") & has("substantial-markup"), "confirmed").when(~has_ds & has("reusable-local"), "likely").otherwise("possible")


def stage_b(profiles: DataFrame, primitives: Column | None = None, reusable: int = REUSABLE_FILES, substantial: int = SUBSTANTIAL_ELEMENTS) -> DataFrame:
    """Adds bucket, classification_source, shadow_level and signals to profiles."""
    df = profiles.withColumn("__all", signals(primitives, reusable, substantial)).withColumn("__neither", neither_code(F.col("component_name"), F.col("jsx_element_count")))
    has = lambda x: F.array_contains("__all", x)
    ds = F.col("has_ds_import")
    rule = F.when(F.col("__neither").isNotNull(), 1).when(ds & has("wraps-with-customization"), 2).when(ds & has("substantial-markup"), 3).when(ds, 4).when(F.size("__all") > 0, 5).otherwise(6)
    r = F.col("__rule")
    return (
        df.withColumn("__rule", rule)
        .withColumns({
            "bucket": F.when(r.isin(2, 3, 5), "shadow").when(r == 4, "adoption").otherwise("neither"),
            "classification_source": F.when(r.isin(2, 3), "wraps-with-customization").when(r == 4, "ds-composition").when(r == 5, "parallel-local-ui").otherwise("utility-heuristic"),
            "shadow_level": F.when(r.isin(2, 3), "possible").when(r == 5, level(ds, F.col("__all"))),
            "signals": F.when(r.isin(2, 3, 4, 5), F.col("__all")).otherwise(F.array().cast("array<string>")),
        })
        .drop("__rule", "__all", "__neither")
    )


def finalise(bound: DataFrame, aliases: DataFrame, verdict: DataFrame) -> DataFrame:
    """The last word on usages: pending ones take the verdict of the profile that their (def_file, symbol)
    stands for; without a profile a library usage is a possible shadow and any other is neither.

    ``bound``: stage A with repo_id, def_file, symbol; ``aliases``: repo_id, def_file, symbol,
    profile_id; ``verdict``: profile_id, b_bucket, b_source, b_level."""
    done = bound.join(aliases, ["repo_id", "def_file", "symbol"], "left").join(verdict, "profile_id", "left")
    lost = F.col("pending") & F.col("profile_id").isNull()
    library = F.col("rule") == 4
    return done.withColumns({
        "bucket": F.coalesce("bucket", "b_bucket", F.when(lost & library, "shadow").otherwise("neither")),
        "classification_source": F.coalesce("classification_source", "b_source", F.when(lost & library, "parallel-local-ui").otherwise("utility-heuristic")),
        "shadow_level": F.when(F.col("pending"), F.coalesce("b_level", F.when(lost & library, "possible"))),
    })


def primitives_of(repos: DataFrame, shared: list[str]) -> DataFrame:
    """(repo_id, primitives): a repo's own list of names, else the shared one. ``repos``: repo_id, own (array or null)."""
    return repos.select("repo_id", F.coalesce("own", F.array(*map(F.lit, shared)) if shared else F.array().cast("array<string>")).alias("primitives"))
