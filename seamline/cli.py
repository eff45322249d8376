"""Command line: index DIR..., grep PATTERN, search TEXT, calls SYMBOL, codebases."""

from __future__ import annotations

import argparse
import os

from seamline.config import Config
from seamline.engine import Engine
from seamline.operators.lines import first_hits, grep_output
from seamline.session import make_session
from seamline.sources.scan import to_json_rows


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="seamline", description=__doc__)
    parser.add_argument("--store", default=os.path.expanduser("~/.seamline"))
    parser.add_argument("--env", default=os.path.expanduser("~/.seamline.env"))
    parser.add_argument("--master", default=None)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index")
    p.add_argument("folders", nargs="+")
    p = sub.add_parser("grep")
    p.add_argument("pattern")
    p.add_argument("-e", "--regex", action="store_true")
    p.add_argument("--ext", default="")
    p.add_argument("--cwd")
    p.add_argument("--no-filename", action="store_true")
    p.add_argument("-m", "--limit", type=int, default=None)
    p = sub.add_parser("search")
    p.add_argument("text")
    p.add_argument("-n", type=int, default=None)
    p.add_argument("--cwd")
    p = sub.add_parser("calls")
    p.add_argument("symbol")
    p.add_argument("--cwd")
    p.add_argument("--direction", default="both", choices=("caller", "callee", "both"))
    p.add_argument("--depth", type=int, default=None)
    sub.add_parser("codebases")
    a = parser.parse_args(argv)
    engine = Engine(make_session(master=a.master), Config.load(a.store, a.env))
    if a.command == "index":
        for folder in a.folders:
            print(folder, engine.sync(folder))
        return 0
    if a.command == "grep":
        rows = engine.grep(a.pattern, a.regex, tuple(x for x in a.ext.split(",") if x), a.cwd)
        rows = rows if a.limit is None else first_hits(rows, "path", a.limit)
        for r in grep_output(rows, "path", names=not a.no_filename).toLocalIterator():
            print(r.value)
        return 0
    rows = {"search": lambda: engine.search(a.text, a.cwd, a.n), "calls": lambda: engine.call_graph(a.symbol, a.cwd, a.direction, a.depth), "codebases": engine.codebases}[a.command]()
    for r in to_json_rows(rows).toLocalIterator():
        print(r.value)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
