"""python -m codeloom COMMAND: index, sync, watch, serve, lsp, or any question by its name."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    from codeloom.plans.api import TOOLS

    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    p.add_argument("command", help="index, sync, watch, serve, lsp, or one of: " + ", ".join(sorted(TOOLS)))
    p.add_argument("values", nargs="*", help="the question's arguments, then name=value for others")
    p.add_argument("--root", default=".", help="the source tree")
    p.add_argument("--store", help="where the graph is kept; by default .codeloom in the tree")
    p.add_argument("--max-file-size", type=int)
    p.add_argument("--embed", action="store_true")
    a = p.parse_args(argv)
    if a.command not in TOOLS and a.command not in ("index", "sync", "watch", "serve", "lsp"):
        p.print_usage(sys.stderr)
        return 2
    needed = TOOLS[a.command][0] if a.command in TOOLS else ()
    plain, named = [v for v in a.values if "=" not in v], dict(v.split("=", 1) for v in a.values if "=" in v)
    if len(plain) != len(needed):
        print(f"{a.command} needs: {' '.join(needed) or 'no arguments'}", file=sys.stderr)
        return 2

    import os

    from pyspark.sql import SparkSession

    from codeloom.plans.api import Workbench, ask

    root = a.root if "://" in a.root else os.path.abspath(a.root)
    store = a.store or f"{root}/.codeloom"
    bench = Workbench(SparkSession.builder.appName("codeloom").getOrCreate(), store if "://" in store else f"file://{os.path.abspath(store)}", root)
    if a.command == "index":
        g = bench.index(a.max_file_size, a.embed)
        print(f"{g.nodes.count()} nodes, {g.edges.count()} edges, {g.refs.count()} open references")
    elif a.command == "watch":
        from codeloom.streaming.sync import watch_tree

        watch_tree(bench.spark, root, bench.snapshots, print).awaitTermination()
    elif a.command == "serve":
        from codeloom.plans.server import ToolServer

        ToolServer(bench).run(sys.stdin, sys.stdout)
    elif a.command == "lsp":
        from codeloom.plans.server import EditorServer

        EditorServer(bench).run(sys.stdin.buffer, sys.stdout.buffer)
    else:
        print(ask(bench, a.command, **dict(zip(needed, plain)), **named))
    return 0


if __name__ == "__main__":
    sys.exit(main())
