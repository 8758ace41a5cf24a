"""The four lookup tools for assistants: plain functions from arguments to text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tarn.operators import lookup
from tarn.plans import search as searching
from tarn.schemas import STRATEGIES
from tarn.sources.embedding import Provider
from tarn.sources.store import Store

#: The tools' names and argument schemas.
SCHEMAS = {
    "get_project_map": {"type": "object", "properties": {"context": {"type": "string"}}},
    "search_codebase": {
        "type": "object",
        "properties": {
            "query": {"type": "string"},
            "strategy": {"type": "string", "enum": list(STRATEGIES)},
            "limit": {"type": "integer", "minimum": 1, "maximum": 50},
            "context": {"type": "string"},
        },
        "required": ["query"],
    },
    "find_symbol": {
        "type": "object",
        "properties": {"name": {"type": "string"}, "type": {"type": "string"}, "context": {"type": "string"}},
        "required": ["name"],
    },
    "get_file_context": {
        "type": "object",
        "properties": {"file_path": {"type": "string"}, "context": {"type": "string"}},
        "required": ["file_path"],
    },
}


def get_project_map(store: Store, root: str = "") -> str:
    return lookup.project_map_text(store.table("documents"), store.table("chunks"), root)


def search_codebase(
    store: Store, query: str, strategy: str = "graph", limit: int = 10, provider: Provider | None = None,
    language: str | None = None, chunk_type: str | None = None, document_path: str | None = None,
) -> str:
    """An unknown strategy falls back to graph; the filters hold before the cut."""
    strategy = strategy if strategy in STRATEGIES else "graph"
    try:
        return searching.markdown(searching.search(store, query, strategy, limit, provider, 0.5, language, chunk_type, document_path))
    except searching.NotReady as why:
        return f"Not ready: {why}"


def find_symbol(store: Store, name: str, type: str | None = None) -> str:
    return searching.symbol_markdown(lookup.find_symbol(store.table("chunks"), name, type, documents=store.table("documents")))


def get_file_context(store: Store, file_path: str) -> str:
    document = store.table("documents").where(F.col("source_path") == file_path).select("document_id").first()
    if document is None:
        return f"{file_path} is not indexed."
    return searching.file_markdown(lookup.file_context(store.table("chunks"), document[0]), file_path)


TOOLS = {f.__name__: f for f in (get_project_map, search_codebase, find_symbol, get_file_context)}


def call(store: Store, name: str, arguments: dict, stores: Callable[[str], Store] | None = None) -> str:
    """A tool's text; a ``context`` argument names another store, which ``stores`` opens."""
    if name not in TOOLS:
        raise KeyError(f"no tool named {name}")
    arguments = dict(arguments)
    context = arguments.pop("context", None)
    if context is not None:
        if stores is None:
            raise ValueError("no contexts to choose from")
        store = stores(context)
    return TOOLS[name](store, **arguments)
