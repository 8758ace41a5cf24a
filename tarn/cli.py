"""Command line: index, search, status, embed and context."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tarn.functions.scalars import readable_bytes, readable_duration
from tarn.plans import indexing, search, tools
from tarn.sources.contexts import Contexts
from tarn.sources.embedding import HashingProvider, HttpProvider
from tarn.sources.store import Store

DEFAULT_LIMIT = 5


def data_dir() -> str:
    return os.environ.get("TARN_DATA_DIR", os.path.expanduser("~/.tarn"))


def provider():
    """The configured model server, or hashed vectors without one."""
    url = os.environ.get("TARN_EMBEDDING_URL")
    dimensions = int(os.environ.get("TARN_EMBEDDING_DIMENSIONS", "768"))
    if not url:
        return HashingProvider(dimensions)
    return HttpProvider(url, os.environ.get("TARN_EMBEDDING_MODEL", "embeddinggemma"), dimensions)


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tarn").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shown(spark: SparkSession, value: Column) -> str:
    return spark.range(1).select(value).first()[0]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarn")
    top.add_argument("--context", help="a context's name; the active one if left out")
    commands = top.add_subparsers(dest="command", required=True)
    a = commands.add_parser("index")
    a.add_argument("path", nargs="?")
    a.add_argument("--force", action="store_true")
    a.add_argument("--prune", action="store_true")
    a.add_argument("--embed", action="store_true")
    a = commands.add_parser("search")
    a.add_argument("query")
    a.add_argument("--strategy", default="graph", choices=("bm25", "vector", "hybrid", "graph"))
    a.add_argument("--limit", type=int, default=DEFAULT_LIMIT)
    a.add_argument("--language", help="only chunks of this language")
    a.add_argument("--type", help="only chunks of this type")
    a.add_argument("--path", help="only chunks of this file")
    commands.add_parser("status")
    commands.add_parser("embed")
    commands.add_parser("map")
    a = commands.add_parser("context")
    a.add_argument("action", choices=("create", "list", "info", "use", "delete", "add", "remove"))
    a.add_argument("name", nargs="?")
    a.add_argument("path", nargs="?")
    return top


def context_command(contexts: Contexts, action: str, name: str | None, path: str | None) -> str:
    if action == "list":
        active = (contexts.active() or {}).get("name")
        return "\n".join(("* " if c["name"] == active else "  ") + c["name"] for c in contexts.list())
    if action == "create":
        return f"created {contexts.create(name, (path,) if path else ())['name']}"
    if action == "info":
        found = contexts.resolve(name)
        return f"{found['name']}\n" + "\n".join(f"  {p}" for p in found["paths"])
    actions = {
        "use": lambda: contexts.use(name),
        "delete": lambda: contexts.delete(name),
        "add": lambda: contexts.add_path(name, path),
        "remove": lambda: contexts.remove_path(name, path),
    }
    actions[action]()
    return f"{action}: {name}"


def main(argv: list[str] | None = None) -> str:
    args = parser().parse_args(argv)
    contexts = Contexts(data_dir())
    if args.command == "context":
        return context_command(contexts, args.action, args.name, args.path)
    context = contexts.resolve(args.context)
    store = Store(session(), contexts.store_path(context["name"]))
    if args.command == "index":
        if args.path:
            contexts.add_path(context["name"], os.path.abspath(args.path))
            context = contexts.get(context["name"])
        out = []
        for path in [os.path.abspath(args.path)] if args.path else context["paths"]:
            job = indexing.index(store, path, args.force, args.prune, provider=provider() if args.embed else None)
            out.append(
                f"{path}: {job.status}, {job.new} new, {job.changed} changed, {job.unchanged} unchanged, "
                f"{job.failed} failed in {shown(store.spark, readable_duration(F.lit(job.seconds * 1000)))}" + (f"\n{job.message}" if job.message else "")
            )
        return "\n".join(out)
    if args.command == "embed":
        return f"{indexing.embed_pending(store, provider())} chunks embedded"
    if args.command == "map":
        return tools.get_project_map(store)
    if args.command == "status":
        totals = indexing.statistics(store.spark, store)
        row = totals["totals"].first()
        size = shown(store.spark, readable_bytes(F.lit(totals["size_bytes"])))
        out = [f"{row['documents']} documents, {row['chunks']} chunks, {size}"]
        for column in ("language", "chunk_type"):
            rows = totals["by_language" if column == "language" else "by_type"].collect()  # a row for each language or type
            wide = max([len(column), *(len(str(r[column])) for r in rows)])
            out += ["", f"{column:<{wide}}  chunks", *(f"{r[column]!s:<{wide}}  {r['chunks']}" for r in rows)]
        return "\n".join(out)
    found = search.search(
        store, args.query, args.strategy, args.limit, provider(), language=args.language, chunk_type=args.type, document_path=args.path
    )
    return search.markdown(found, lines=3)


if __name__ == "__main__":
    print(main())
