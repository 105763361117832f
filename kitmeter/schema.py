"""Schemas and fixed values of the dataset.

Labels and field names that carry the name of the design system are made from
``Vocabulary``: with name "ds" the category is ``ds``, the source ``direct-ds``
and the JSON field ``dsPackage``. Inside the engine columns are snake_case and
carry the neutral name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SCHEMA_VERSION = "1.1"

BUCKETS = ("adoption", "shadow", "neither")
LEVELS = ("confirmed", "likely", "possible")
ROUTE_KINDS = ("bound", "shared", "unmapped", "unsupported")
CATEGORIES = ("html-native", "ds", "local", "local-library", "third-party")
SOURCES = ("direct-ds", "ds-backed-wrapper", "ds-composition", "wraps-with-customization", "parallel-local-ui", "utility-heuristic", "manual-override")

# Names of primitive components.
PRIMITIVES = (
    "Button", "Input", "TextField", "Select", "Checkbox", "Radio", "Switch",
    "Toggle", "Text", "Heading", "Title", "Label", "Icon", "Avatar", "Badge",
    "Tag", "Chip", "Card", "Modal", "Dialog", "Drawer", "Tooltip", "Popover",
    "Popup", "Menu", "Dropdown", "Tab", "Tabs", "Panel", "Accordion",
    "Divider", "Spacer", "Stack", "Flex", "Grid", "Box", "Container",
    "Alert", "Notification", "Toast", "Skeleton", "Spinner", "Loader",
    "Progress",
)


@dataclass(frozen=True)
class Vocabulary:
    """Names that carry the design system's own name."""

    name: str = "ds"

    def label(self, x: str | None) -> str | None:
        if x is None:
            return None
        return {"ds": self.name, "direct-ds": f"direct-{self.name}", "ds-backed-wrapper": f"{self.name}-backed-wrapper", "ds-composition": f"{self.name}-composition"}.get(x, x)

    def field(self, x: str) -> str:
        capital = self.name[:1].upper() + self.name[1:]
        return {"ds_package": f"{self.name}Package", "ds_backed_by_lib": f"{self.name}BackedByLib", "ds_imports": f"{self.name}Imports", "ds_candidate_mapping": f"{self.name}CandidateMapping", "ds_coverage": f"{self.name}Coverage", "ds_component_usage": f"{self.name}ComponentUsage", "ds_version": f"{self.name}Version", "add_to_ds": f"add-to-{self.name}", "min_repos": f"addTo{capital}MinRepos"}[x]


ROUTE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("path", T.StringType()), T.StructField("paths", T.ArrayType(T.StringType(), False))])

USAGE = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("component_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("bucket", T.StringType()),
    T.StructField("shadow_level", T.StringType()),
    T.StructField("classification_source", T.StringType()),
    T.StructField("ds_package", T.StringType()),
    T.StructField("canonicalized_via", T.StringType()),
    T.StructField("local_lib_id", T.StringType()),
    T.StructField("ds_backed_by_lib", T.BooleanType()),
    T.StructField("route", ROUTE),
    T.StructField("resolution", T.StringType()),
])

_STRINGS = T.ArrayType(T.StringType(), False)

SHADOW = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("component_name", T.StringType()),
    T.StructField("prop_names", _STRINGS),
    T.StructField("jsx_element_count", T.IntegerType()),
    T.StructField("local_imports", _STRINGS),
    T.StructField("ds_imports", _STRINGS),
    T.StructField("html_tags", _STRINGS),
    T.StructField("uses_styled", T.BooleanType()),
    T.StructField("directory_segments", _STRINGS),
    T.StructField("feature", T.StringType()),
    T.StructField("code_snippet", T.StringType()),
    T.StructField("code_snippet_truncated", T.BooleanType()),
    T.StructField("usage_count", T.LongType()),
    T.StructField("files_used_in", T.LongType()),
    T.StructField("shadow_level", T.StringType()),
    T.StructField("signals", _STRINGS),
])

UNRESOLVED = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("reason", T.StringType()), T.StructField("context", T.StringType())])

WARNING = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("abs_path", T.StringType()), T.StructField("code", T.StringType()), T.StructField("message", T.StringType())])
