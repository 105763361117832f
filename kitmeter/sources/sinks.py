"""Files a scan leaves: JSON, one text file, CSV, an HTML report."""

from __future__ import annotations

import html
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import opened


def write_json(value: Any, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)


class LinesWriter(DataSourceWriter):
    """Tasks write their partitions of sorted lines side by side; the commit knows the bytes of each and so where it stands in the whole.

    Parts are named by attempt, so a task that ran twice leaves a part that nothing names. ``manifest.json`` lists the parts
    in order with their offsets; it appears only after all parts have, and a failed write takes its folder away.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> Part:
        store, base = opened(self.path)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, size, lines = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.jsonl", 0, 0
        with store.open_output_stream(f"{base}/{name}") as f:
            for row in rows:
                line = (row["value"] + "\n").encode()
                f.write(line)
                size, lines = size + len(line), lines + 1
        return Part(task.partitionId(), name, size, lines)

    def commit(self, messages: list[Part | None]) -> None:
        store, base = opened(self.path)
        at, parts = 0, []
        for p in sorted((m for m in messages if m), key=lambda m: m.number):
            parts.append({"name": p.name, "offset": at, "bytes": p.size, "rows": p.rows})
            at += p.size
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/manifest.json") as f:
            f.write(json.dumps({"bytes": at, "rows": sum(p["rows"] for p in parts), "parts": parts}).encode())

    def abort(self, messages: list[Part | None]) -> None:
        store, base = opened(self.path)
        store.delete_dir_contents(base, missing_dir_ok=True)


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    size: int
    rows: int


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: Any, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"])


def write_ordered(lines: DataFrame, folder: str) -> None:
    """Sorted rows (``value``) as parts and a manifest; the parts in its order are the sorted file."""
    lines.sparkSession.dataSource.register(Lines)
    lines.select("value").write.format("ordered_lines").option("path", folder).mode("append").save()


def join_parts(folder: str, path: str) -> None:
    """The parts of a folder as one file, in order: bytes are copied, rows never leave the tasks."""
    store, base = opened(folder)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.readall())
    with open(path, "wb") as out:
        for p in manifest["parts"]:
            with store.open_input_stream(f"{base}/{p['name']}") as f:
                shutil.copyfileobj(f, out, 1 << 20)


def write_single_text(lines: DataFrame, path: str) -> None:
    """Sorted rows as one file: parts are written by the tasks, then joined."""
    folder = f"{os.path.abspath(path)}.parts-{uuid.uuid4().hex}"
    write_ordered(lines, folder)
    join_parts(folder, path)
    store, base = opened(folder)
    store.delete_dir(base)


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV, in its order; cells are quoted where they need it."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def embedded(value: Any) -> str:
    """JSON that may stand in a script element."""
    text = json.dumps(value, ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def _table(title: str, rows: list[dict[str, Any]]) -> str:
    if not rows:
        return f"<h2>{html.escape(title)}</h2><p>None.</p>"
    show = lambda x: html.escape(f"{x:.4g}" if isinstance(x, float) else json.dumps(x, ensure_ascii=False) if isinstance(x, (list, dict)) else str(x))
    head = "".join(f"<th>{html.escape(k)}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{show(x)}</td>" for x in r.values()) + "</tr>" for r in rows)
    return f"<h2>{html.escape(title)} ({len(rows)})</h2><input placeholder='Filter'><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


_SCRIPT = """
for (const input of document.querySelectorAll('input')) input.oninput = () => {
  const q = input.value.toLowerCase();
  for (const tr of input.nextElementSibling.tBodies[0].rows) tr.hidden = !tr.innerText.toLowerCase().includes(q);
};
for (const th of document.querySelectorAll('th')) th.onclick = () => {
  const body = th.closest('table').tBodies[0], k = th.cellIndex, down = th.dataset.down = th.dataset.down ? '' : '1';
  const key = tr => tr.cells[k].innerText, num = s => s !== '' && !isNaN(s);
  [...body.rows].sort((a, b) => (num(key(a)) && num(key(b)) ? key(a) - key(b) : key(a).localeCompare(key(b))) * (down ? -1 : 1)).forEach(tr => body.append(tr));
};
"""


def write_report(found: dict[str, Any], path: str) -> None:
    """One HTML file with the result document inside; tables filter and sort in the page."""
    m = found["metrics"]
    tables = [("Repositories", m["perRepoAdoption"]), ("Shadow by component", m["shadowLandscape"]["byComponent"]), ("Shadow by file", m["shadowLandscape"]["byFile"]), ("Routes", m["perRouteAdoption"]), ("Shared components", m["sharedComponentsAdoption"])]
    tables += [(k, x) for k, x in m.items() if isinstance(x, list) and not any(x is t for _, t in tables)]
    tables += [("Recommendations", found["recommendations"]), ("Warnings", found["warnings"])]
    value = m["globalAdoption"]["value"]
    body = f"<h1>Adoption {value:.1%}</h1><p>{html.escape(json.dumps(m['bucketDistribution']))}</p>" + "".join(_table(t, r) for t, r in tables)
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px;text-align:left}th{cursor:pointer}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!DOCTYPE html><meta charset='utf-8'><title>Adoption report</title><style>{style}</style>{body}<script>const data = {embedded(found)};{_SCRIPT}</script>\n")


def clean_cache(folder: str = ".cache") -> bool:
    """Remove the cache of checkouts."""
    there = os.path.isdir(folder)
    shutil.rmtree(folder, ignore_errors=True)
    return there
