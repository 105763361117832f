"""Source trees as a data source: a row for each file, read where the tasks run, from any store that Arrow opens.

    spark.dataSource.register(Trees)
    spark.read.format("trees").option("trees", json.dumps([{"tree": "a", "root": "s3://bucket/a", "include": ["[.]tsx?$"]}])).load()

A tree is split into one partition for the files at its top and one for each folder there, so a large repo is read by many
tasks. Pruned folders are not listed. ``content`` is read only where a name meets a pattern of ``include``, none of ``exclude``, and the option ``content`` is not
false; a file, or a folder, that can't be read is a row with its message instead. ``only`` names files to read without listing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "tree string, path string, abs_path string, content string, message string"
PRUNED = ("node_modules", "dist", "build", ".next", ".git")


def opened(root: str) -> tuple[Any, str]:
    """The Arrow file system of a root, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class Folder(InputPartition):
    def __init__(self, tree: dict[str, Any], folder: str, deep: bool):
        self.tree, self.folder, self.deep = tree, folder, deep


class TreesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.trees = json.loads(options.get("trees", "[]"))
        self.content = options.get("content", "true") != "false"

    def partitions(self) -> list[Folder]:
        out = []
        for tree in self.trees:
            out.append(Folder(tree, "", False))
            if "only" not in tree:
                try:
                    out += [Folder(tree, x.base_name, True) for x in self._entries(tree, "")[1]]
                except (OSError, ValueError):
                    pass  # told by the task that reads the top
        return out or [Folder({"tree": None, "only": []}, "", False)]

    @staticmethod
    def _entries(tree: dict[str, Any], folder: str) -> tuple[list[Any], list[Any]]:
        """Files and folders in a folder, in order; none where there is no such folder."""
        from pyarrow import fs

        store, base = opened(tree["root"])
        if not folder and store.get_file_info([base])[0].type != fs.FileType.Directory:
            return [], []
        found = sorted(store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)), key=lambda x: x.base_name)
        pruned = tree.get("pruned", PRUNED)
        return [x for x in found if x.type == fs.FileType.File], [x for x in found if x.type == fs.FileType.Directory and x.base_name not in pruned]

    def read(self, partition: Folder) -> Iterator[tuple]:
        tree, name = partition.tree, partition.tree["tree"]
        if "only" in tree:
            for path in tree["only"]:
                yield from self._file(tree, path, True)
            return
        yes, no = ([re.compile(x) for x in tree.get(k, ())] for k in ("include", "exclude"))
        stack = [partition.folder]
        while stack:
            folder = stack.pop()
            try:
                files, folders = self._entries(tree, folder)
            except (OSError, ValueError) as e:
                yield name, None, None, None, str(e)[:200]
                continue
            at = f"{folder}/" if folder else ""
            for x in files:
                path = at + x.base_name
                wanted = self.content and any(p.search(path) for p in yes) and not any(p.search(path) for p in no)
                yield from self._file(tree, path, wanted) if wanted else [(name, path, f"{tree['root']}/{path}", None, None)]
            if partition.deep:
                stack += [at + x.base_name for x in folders]

    @staticmethod
    def _file(tree: dict[str, Any], path: str, required: bool) -> Iterator[tuple]:
        where = f"{tree['root']}/{path}"
        store, base = opened(tree["root"])
        try:
            with store.open_input_stream(f"{base}/{path}") as f:
                yield tree["tree"], path, where, f.readall().decode("utf-8", "replace"), None
        except FileNotFoundError:
            if "only" not in tree:
                yield tree["tree"], path, where, None, "gone"
        except OSError as e:
            yield tree["tree"], path, where, None, str(e)[:200]


class Trees(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trees"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> TreesReader:
        return TreesReader(dict(self.options))


def read(spark: SparkSession, trees: list[dict[str, Any]], content: bool = True) -> DataFrame:
    """(tree, path, abs_path, content, message) of all files of some trees."""
    spark.dataSource.register(Trees)
    return spark.read.format("trees").option("trees", json.dumps(trees)).option("content", "true" if content else "false").load()
