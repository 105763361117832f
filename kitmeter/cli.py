"""Command line: run, aggregate, report, update, clean."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .schema import Vocabulary
from .sources import config as C
from .sources import sinks


def main(args: list[str] | None = None) -> int:
    """Exit codes: 0 done, 1 failed, 2 bad configuration, 3 invariants violated."""
    p = argparse.ArgumentParser(prog="kitmeter")
    p.add_argument("--name", default="ds", help="the design system's name in labels and fields")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "analyze"):
        r = sub.add_parser(name)
        r.add_argument("--config", default="scan.config.json")
        r.add_argument("--repositories", default="repositories.json")
        r.add_argument("--output")
        r.add_argument("--no-fail-on-invariant", action="store_true")
    a = sub.add_parser("aggregate")
    a.add_argument("dataset")
    a.add_argument("--warnings")
    a.add_argument("--output", default="aggregates.json")
    v = sub.add_parser("report")
    v.add_argument("aggregates")
    v.add_argument("--output", default="report.html")
    u = sub.add_parser("update")
    u.add_argument("--cache", default=".cache")
    c = sub.add_parser("clean")
    c.add_argument("--cache", default=".cache")
    o = p.parse_args(args)
    try:
        if o.command in ("run", "analyze"):
            from .plans import scan
            from .session import build

            found = scan.run(build(), o.config, o.repositories, o.output, Vocabulary(o.name))
            print(f"adoption {found['metrics']['globalAdoption']['value']:.4f}, {found['meta']['filesScanned']} files, {len(found['warnings'])} warnings: {found['output']}")
            return 3 if found["invariants"]["failed"] and not o.no_fail_on_invariant else 0
        if o.command == "aggregate":
            from .plans import scan
            from .session import build

            sinks.write_json(scan.aggregate_dataset(build(), o.dataset, o.warnings, Vocabulary(o.name)), o.output)
        elif o.command == "report":
            with open(o.aggregates, encoding="utf-8") as f:
                sinks.write_report(json.load(f), o.output)
        elif o.command == "update":
            for name in sorted(os.listdir(o.cache)) if os.path.isdir(o.cache) else []:
                print(name, "updated" if C.pull(os.path.join(o.cache, name)) else "failed")
        else:
            sinks.clean_cache(o.cache)
    except C.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
