"""python -m quernal.cli {search,related,symbol,symbols-at,stats,info,status,clear,savings} ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from quernal.operators import savings
from quernal.plans import render, session
from quernal.plans.storage import Folder

COMMANDS = {
    "search": ("ranked chunks for a query", ["query"]), "related": ("chunks like the one at a line", ["file_path", "line"]), "symbol": ("where a name is defined and referenced", ["name"]),
    "symbols-at": ("the same for all names that the chunk at a line declares", ["file_path", "line"]), "stats": ("build or refresh the index, and count", []), "info": ("is a source's index there", []),
    "status": ("all indexes", []), "clear": ("delete an index, or all with --all", []), "savings": ("report of the ledger", []),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quernal")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (says, arguments) in COMMANDS.items():
        command = commands.add_parser(name, help=says)
        for argument in arguments:
            command.add_argument(argument)
        command.add_argument("--source", help="path or git URL (the working folder)")
        command.add_argument("--ref", help="branch or tag of a git URL")
        command.add_argument("--cache", help="folder of all indexes, or 'none'")
        command.add_argument("--encoder", help="'hash' or the path of a token table")
        command.add_argument("--include-text", action="store_true", help="Markdown, JSON and YAML too")
        if name in ("search", "related", "savings"):
            command.add_argument("--ledger", help="where what was saved is logged, or 'none'")
        if name in ("search", "related"):
            command.add_argument("-k", type=int, default=5)
            command.add_argument("--context", type=int, help="lines around each result")
        if name == "search":
            command.add_argument("--mode", default="hybrid")
            command.add_argument("--alpha", type=float)
            command.add_argument("--language", action="append")
            command.add_argument("--path", action="append")
        if name == "clear":
            command.add_argument("--all", action="store_true")
    return top


def main(argv: list[str] | None = None) -> str:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quernal").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "savings":
        path = session.ledger_path(a.ledger)
        if path is None or not Folder(spark, path).exists():
            return "nothing is logged yet"
        rows = savings.read(spark, path)
        return savings.report(savings.summary(rows, time.time()).collect(), savings.calls(rows).collect())
    root = session.cache_root() if a.cache is None else None if a.cache == session.NO_CACHE else a.cache
    if a.command == "status":
        return session.status(spark, root)
    if a.command == "clear" and a.all:
        if root:
            session.clear(spark, root)
        return "cleared"
    source, encoder = session.resolve_source(session.choose_source(a.source, None), a.ref), session.resolve_encoder(a.encoder)
    if a.command == "clear":
        if root:
            session.clear(spark, root, source, a.include_text, encoder)
        return "cleared"
    if a.command == "info":
        return session.info(spark, root, source, a.include_text, encoder)
    index = session.Session(spark, root, encoder=encoder, ledger=session.ledger_path(a.ledger) if "ledger" in a else None).get(source.handle, source.ref, a.include_text)
    if a.command == "stats":
        row = index.stats().first()
        return f"{row.indexed_files} files, {row.total_chunks} chunks, {row.languages}"
    if a.command in ("symbol", "symbols-at"):
        rows = index.symbol(a.name) if a.command == "symbol" else index.symbols_at(a.file_path, int(a.line))
        found = [r.asDict() for r in index.with_content(rows).collect()]
        return "\n\n".join(render.symbols(name, [r for r in found if r["name"] == name]) for name in sorted({r["name"] for r in found})) or "nothing found"
    if a.command == "search":
        found = index.search(a.query, a.k, a.mode, a.alpha, a.language, a.path, a.context)
    else:
        found = index.find_related(a.file_path, int(a.line), a.k, a.context)
    rows = [r.asDict() for r in found.collect()]
    return render.hint(a.query, a.mode) if not rows and a.command == "search" else render.results(f"# {a.command}", rows)


def run() -> None:
    print(main())


if __name__ == "__main__":
    run()
