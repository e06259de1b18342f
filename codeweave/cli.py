"""Command line: index, stats, query, reset-index.

    python -m codeweave.cli --store DIR index PATH [--ext .py,.rb] [--ignore dir,dir] [--level low|med|high]
    python -m codeweave.cli --store DIR stats
    python -m codeweave.cli --store DIR query --question TEXT [--repo NAME] [--limit 10] [--depth 2]
    python -m codeweave.cli --store DIR reset-index

The store is a folder of any file system that Spark reads; CODEGRAPH_STORE names it where --store does not.
"""

from __future__ import annotations

import argparse
import os
import posixpath
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.text import extensions_option
from .plans import replies
from .plans.api import CodeGraph

RULE = "─" * 41


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codeweave", description="Index code bases as a graph, and query it.")
    top.add_argument("--store", default=os.environ.get("CODEGRAPH_STORE", "codegraph"), help="folder of the graph's tables")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="scan and index a local repository")
    index.add_argument("path")
    index.add_argument("--ext", help='extensions to index, e.g. ".py,.rb"')
    index.add_argument("--ignore", help="names of folders to skip, too")
    index.add_argument("--level", default="high", choices=["low", "med", "high"])
    commands.add_parser("stats", help="show what is indexed")
    query = commands.add_parser("query", help="ask a question in natural language")
    query.add_argument("--question", required=True)
    query.add_argument("--repo")
    query.add_argument("--limit", type=int, default=10)
    query.add_argument("--depth", type=int, default=2)
    commands.add_parser("reset-index", help="drop the embeddings, as when their model changes")
    return top


def shown(found: DataFrame) -> str:
    """Results one after another, each under a rule."""
    rows = sorted(found.collect(), key=lambda r: (-r["score"], r["id"]))
    out = [f"\n{RULE}\n{r['type']}  {r['name']}  (score: {r['score']:.3f})\nFile: {r['file_path']}  L{r['start_line']}\n" + "\n".join(r["source_lines"]) for r in rows]
    return "\n".join(out) or "No results found."


def run(graph: CodeGraph, args: argparse.Namespace, say: Callable[[str], object] = print) -> None:
    if args.command == "index":
        root = os.path.abspath(args.path)
        repo, began = posixpath.basename(root), time.time()
        say(f"Indexing {root} [level={args.level}] …")
        ignore = [x.strip() for x in args.ignore.split(",")] if args.ignore else None
        done = graph.index_repo(root, repo, args.level, extensions_option(args.ext) if args.ext else None, ignore).first()
        say(f"✓  {done['files_scanned']} files · {done['nodes_found']} nodes · {done['edges_found']} edges ({int(1000 * (time.time() - began))}ms)")
        if args.level != "low":
            say(f"✓  {graph.embeddings_of(repo)} embeddings stored")
    elif args.command == "stats":
        say(replies.statistics(graph.get_stats(), graph.edge_total().first()["edges"], graph.store.folder, detailed=False))
    elif args.command == "query":
        say(shown(graph.query_codebase(args.question, depth=args.depth, limit=args.limit, repo=args.repo)))
    else:
        graph.reset_index()
        say("✓ Done. Now index again.")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("codeweave").getOrCreate()
    try:
        run(CodeGraph(spark, args.store), args)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
