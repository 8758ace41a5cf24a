"""The symbol graph: its edges, and search by seeds and two hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.scalars import BM25_SEED_WEIGHT, name_tier, short_name, type_multiplier
from tarn.operators.lexical import normalised, sent
from tarn.operators.names import matches
from tarn.sources.scratch import written

CALLABLE = ("function", "method")
TYPES = ("class", "interface")
WEIGHTS = {"contains": 1.0, "extends": 0.9, "implements": 0.85, "calls": 0.6}
MIN_CALL_NAME = 4
SEEDS, HOPS, DECAY, OVER_FETCH = 20, 2, 0.6, 3


def _edge(kind: str, to_id, to_name, resolved):
    return [
        F.sha2(F.concat_ws("\0", F.lit(kind), "from_chunk_id", F.coalesce(to_id, F.lit("")), to_name), 256).alias("edge_id"),
        F.col("from_chunk_id"),
        to_id.alias("to_chunk_id"),
        to_name.alias("to_name"),
        F.lit(kind).alias("edge_type"),
        F.lit(WEIGHTS[kind]).alias("weight"),
        resolved.alias("resolved"),
    ]


def contains_edges(chunks: DataFrame) -> DataFrame:
    """Class to method, within a document, by the method's parent name."""
    owner = chunks.where(F.col("chunk_type") == "class").select(
        "document_id", F.col("name").alias("parent"), F.col("chunk_id").cast("string").alias("from_chunk_id")
    )
    methods = chunks.where((F.col("chunk_type") == "method") & F.col("metadata.parentName").isNotNull()).select(
        "document_id",
        F.col("metadata.parentName").alias("parent"),
        F.col("chunk_id").cast("string").alias("to_id"),
        "name",
    )
    return methods.join(owner, ["document_id", "parent"]).select(
        *_edge("contains", F.col("to_id"), F.col("name"), F.lit(True))
    )


def _unique_types(chunks: DataFrame) -> DataFrame:
    """(to_name, to_id) of the classes and interfaces whose name is theirs alone."""
    kinds = chunks.where(F.col("chunk_type").isin(*TYPES))
    return (
        kinds.groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"), F.first("chunk_id").cast("string").alias("to_id"))
        .where("n = 1")
        .select(F.col("name").alias("to_name"), "to_id")
    )


def heritage_edges(chunks: DataFrame, unique: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Extends and implements, resolved when exactly one class or interface has the name.

    ``unique`` (to_name, to_id) are the names of the whole corpus, if ``chunks`` are a part of it;
    ``asked`` (to_name) restricts the edges to these names.
    """
    kinds = chunks.where(F.col("chunk_type").isin(*TYPES))
    unique = _unique_types(chunks) if unique is None else unique
    out = None
    for kind, field in (("extends", "extendsNames"), ("implements", "implementsNames")):
        wanted = kinds.select(
            F.col("chunk_id").cast("string").alias("from_chunk_id"), F.explode(f"metadata.{field}").alias("to_name")
        )
        if asked is not None:
            wanted = wanted.join(asked, "to_name", "left_semi")
        edges = wanted.join(unique, "to_name", "left").select(
            *_edge(kind, F.col("to_id"), F.col("to_name"), F.col("to_id").isNotNull())
        )
        out = edges if out is None else out.unionByName(edges)
    return out


def call_names(chunks: DataFrame) -> DataFrame:
    """(short, to_id) of the callables whose short name is long enough and theirs alone."""
    callables = chunks.where(F.col("chunk_type").isin(*CALLABLE))
    named = callables.select(short_name(F.col("name")).alias("short"), F.col("chunk_id").cast("string").alias("to_id"))
    return (
        named.where(F.length("short") >= MIN_CALL_NAME)
        .groupBy("short")
        .agg(F.count(F.lit(1)).alias("n"), F.first("to_id").alias("to_id"))
        .where("n = 1")
        .drop("n")
    )


def call_edges(chunks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Callable to callable whose short name stands as a whole word in its content.

    Identifiers are taken from each content once and joined by equality. Names with other
    characters are few; only they are searched for one by one. ``names`` (short, to_id) are the
    callables looked for; without, those of ``chunks``.
    """
    source = chunks.where(F.col("chunk_type").isin(*CALLABLE)).select(
        F.col("chunk_id").cast("string").alias("from_chunk_id"), "content"
    )
    names = call_names(chunks) if names is None else names
    plain = F.col("short").rlike("^[A-Za-z0-9_]+$")
    # Other names are looked up by the rarest of their plain pieces, then compared as a whole.
    odd = names.where(~plain)
    cut = odd.select("short", "to_id", F.explode(F.array_distinct(F.regexp_extract_all("short", F.lit("([A-Za-z0-9_]+)"), F.lit(1)))).alias("piece"))
    spread = cut.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = cut.join(spread, "piece").groupBy("short", "to_id").agg(F.min(F.struct("n", "piece"))["piece"].alias("piece"))
    looked_up = names.where(plain).select("short", "to_id", F.col("short").alias("piece"), F.lit(False).alias("odd")).unionByName(
        rarest.withColumn("odd", F.lit(True))
    )
    # Only ids and pieces are exploded and joined; contents come back for the few hits of odd names.
    words = F.array_distinct(F.regexp_extract_all("content", F.lit("([A-Za-z0-9_]+)"), F.lit(1)))
    hits = source.select("from_chunk_id", F.explode(words).alias("piece")).join(looked_up, "piece")
    found = hits.where(~F.col("odd")).select("from_chunk_id", "to_id", "short")
    left = F.when(F.col("short").rlike("^[A-Za-z0-9_]"), r"(?<![A-Za-z0-9_])").otherwise(r"(?<=[A-Za-z0-9_])")
    right = F.when(F.col("short").rlike("[A-Za-z0-9_]$"), r"(?![A-Za-z0-9_])").otherwise(r"(?=[A-Za-z0-9_])")
    pattern = F.concat(left, F.lit(r"\Q"), "short", F.lit(r"\E"), right)
    also = (
        hits.where("odd")
        .join(source, "from_chunk_id")
        .where(F.regexp_like("content", pattern))
        .select("from_chunk_id", "to_id", "short")
    )
    return (
        found.unionByName(also)
        .where(F.col("from_chunk_id") != F.col("to_id"))
        .distinct()
        .select(*_edge("calls", F.col("to_id"), F.col("short"), F.lit(True)))
    )


def edges(chunks: DataFrame) -> DataFrame:
    """All edges of a corpus, one of each id."""
    found = contains_edges(chunks).unionByName(heritage_edges(chunks)).unionByName(call_edges(chunks))
    return found.dropDuplicates(["edge_id"])


def _owners(chunks: DataFrame) -> DataFrame:
    """(kind, name, id): what an edge can resolve to, types by name and callables by short name."""
    chunk = F.col("chunk_id").cast("string").alias("id")
    types = chunks.where(F.col("chunk_type").isin(*TYPES)).select(F.lit("type").alias("kind"), "name", chunk)
    short = short_name(F.col("name"))
    calls = chunks.where(F.col("chunk_type").isin(*CALLABLE)).select(F.lit("call").alias("kind"), short.alias("name"), chunk)
    return types.unionByName(calls.where(F.length("name") >= MIN_CALL_NAME))


def _alone(owners: DataFrame, as_: str) -> DataFrame:
    """(kind, name, id) of the names with one owner."""
    found = owners.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.first("id").alias(as_))
    return found.where("n = 1").drop("n")


def changed_names(others: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, name, to_id): names whose only owner changes when the chunks ``old`` become ``new``; to_id: the new one, if any.

    Of the other chunks only names that ``old`` or ``new`` have are counted.
    """
    asked = _owners(old).unionByName(_owners(new)).select("kind", "name").distinct()
    rest = _owners(others).join(asked, ["kind", "name"], "left_semi")
    before, after = _alone(rest.unionByName(_owners(old)), "was"), _alone(rest.unionByName(_owners(new)), "to_id")
    both = asked.join(before, ["kind", "name"], "left").join(after, ["kind", "name"], "left")
    return both.where(~F.col("was").eqNullSafe(F.col("to_id"))).select("kind", "name", "to_id")


def edge_changes(others: DataFrame, old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh, names): what is to add to the edges when the chunks ``old`` of some documents become ``new``.

    ``others`` are the chunks of all other documents. ``fresh`` are the edges from ``new`` chunks, and
    those from others to a name of ``names`` (kind, name, to_id). Stored edges from ``old`` chunks
    and to these names are to go. Contents of others are only read if a name has a new owner.
    """
    names = written(changed_names(others, old, new), "edge-names")
    everyone = others.select("chunk_id", "chunk_type", "name").unionByName(new.select("chunk_id", "chunk_type", "name"))
    types = names.where("kind = 'type'").select(F.col("name").alias("to_name"), "to_id")
    fresh = contains_edges(new).unionByName(heritage_edges(new, _unique_types(everyone))).unionByName(call_edges(new, call_names(everyone)))
    fresh = fresh.unionByName(heritage_edges(others, types.where("to_id is not null"), types.select("to_name")))
    calls = names.where("kind = 'call' and to_id is not null").select(F.col("name").alias("short"), "to_id")
    if not calls.isEmpty():
        fresh = fresh.unionByName(call_edges(others, calls))
    return fresh.dropDuplicates(["edge_id"]), names


def outdated(edge_rows: DataFrame, old: DataFrame, names: DataFrame) -> DataFrame:
    """The stored edges that ``edge_changes`` replaces: from ``old`` chunks, or to a changed name."""
    gone = old.select(F.col("chunk_id").cast("string").alias("from_chunk_id"), F.lit(True).alias("gone")).distinct()
    kind = F.when(F.col("edge_type") == "calls", "call").when(F.col("edge_type").isin("extends", "implements"), "type")
    named = names.select("kind", F.col("name").alias("to_name"), F.lit(True).alias("named"))
    marked = edge_rows.withColumn("kind", kind).join(gone, "from_chunk_id", "left").join(named, ["kind", "to_name"], "left")
    return marked.where(F.col("gone") | F.col("named")).select(*edge_rows.columns)


def updated_edges(edge_rows: DataFrame, others: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """All edges of ``others`` and ``new``, from those of ``others`` and ``old``."""
    fresh, names = edge_changes(others, old, new)
    gone = outdated(edge_rows, old, names).select("edge_id").distinct()
    return edge_rows.join(gone, "edge_id", "left_anti").unionByName(fresh.select(*edge_rows.columns)).dropDuplicates(["edge_id"])


def name_seeds(chunks: DataFrame, queries: DataFrame, limit: int = SEEDS, escape: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, seed): per query token the shortest matching names, best tiers kept.

    A chunk keeps the tier of the first token that found it. ``queries`` is (query_id, text), any number.
    """
    words = queries.select("query_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("at", "token"))
    words = words.where(F.length("token") >= 2)
    words = words.groupBy("query_id", "token").agg(F.min("at").alias("at"))
    named = chunks.select(F.col("chunk_id"), "name")
    hits = matches(named, words, escape).join(words, ["query_id", "token"]).join(named, "name")
    nearest = F.row_number().over(
        Window.partitionBy("query_id", "token").orderBy(F.length("name"), "chunk_id")
    )
    hits = hits.withColumn("near", nearest).where(F.col("near") <= limit)
    hits = hits.withColumn("score", name_tier(F.col("name"), F.col("token")))
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("at"))
    hits = hits.withColumn("first", first).where("first = 1")
    seed = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "at", F.length("name"), "chunk_id")
    )
    return hits.withColumn("seed", seed).where(F.col("seed") <= limit).select("query_id", "chunk_id", "score", "seed")


def all_seeds(names: DataFrame, lexical: DataFrame) -> DataFrame:
    """Name seeds over lexical ones; the queue holds the lexical list first, then new names."""
    a = lexical.select(
        "query_id", "chunk_id", (F.col("score") * BM25_SEED_WEIGHT).alias("ls"), F.col("rank").alias("at")
    )
    b = names.select("query_id", "chunk_id", F.col("score").alias("ns"), (F.col("seed") + 1_000_000).alias("nat"))
    return a.join(b, ["query_id", "chunk_id"], "full").select(
        "query_id",
        "chunk_id",
        F.coalesce("ns", "ls").alias("score"),
        F.coalesce("at", "nat").cast("long").alias("seed"),
    )


def directed(edge_rows: DataFrame) -> DataFrame:
    """Resolved edges both ways: (here, there, weight, way, edge_order); outgoing ones come first."""
    kind = F.array_position(F.array(*[F.lit(k) for k in WEIGHTS]), F.col("edge_type"))
    order = F.struct(kind.alias("kind"), "from_chunk_id", "to_chunk_id", "to_name")
    known = edge_rows.where(F.col("resolved") & F.col("to_chunk_id").isNotNull())
    out = F.struct(F.col("from_chunk_id").alias("here"), F.col("to_chunk_id").alias("there"), F.lit(0).alias("way"))
    back = F.struct(F.col("to_chunk_id").alias("here"), F.col("from_chunk_id").alias("there"), F.lit(1).alias("way"))
    # Both directions come from one row, so the edges are made once, not once a direction.
    return known.select("weight", order.alias("edge_order"), F.explode(F.array(out, back)).alias("e")).select(
        "e.here", "e.there", "weight", "e.way", "edge_order"
    )


def expanded(seeds: DataFrame, edge_rows: DataFrame, decay: float = DECAY, hops: int = HOPS) -> DataFrame:
    """(query_id, chunk_id, score, level): the best score of every node within ``hops`` of the seeds.

    The queue is first in, first out and a node expands once, with the score it was first
    queued with; so each level starts from its nodes' first entries, not their best. An entry's
    place is that of its parent, then the edge's.
    """
    links = directed(edge_rows)
    node = ["query_id", "chunk_id"]
    frontier = seeds.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "score", F.struct("seed").alias("queued"))
    known = frontier.select(*node)
    rows = frontier.select(*node, "score", F.lit(0).alias("level"))
    for level in range(1, hops + 1):
        reached = frontier.join(links, F.col("chunk_id") == F.col("here")).select(
            "query_id",
            F.col("there").alias("chunk_id"),
            (F.col("score") * F.col("weight") * decay).alias("score"),
            F.struct("queued", "way", "edge_order").alias("queued"),
        )
        if level > 1 and level < hops:
            reached = written(reached, "reached")  # else each level would be made again for the next
        rows = rows.unionByName(reached.select(*node, "score", F.lit(level).alias("level")))
        if level < hops:
            first = F.row_number().over(Window.partitionBy(*node).orderBy("queued"))
            frontier = reached.withColumn("first", first).where("first = 1").drop("first").join(known, node, "left_anti")
            known = known.unionByName(frontier.select(*node))
    return rows.groupBy(*node).agg(F.max("score").alias("score"), F.min("level").alias("level"))


def search_batch(
    chunks: DataFrame, edge_rows: DataFrame, seeds: DataFrame, limit: int = 10, among: DataFrame | None = None,
    n_queries: int | None = None, hops: int = HOPS,
) -> DataFrame:
    """(query_id, chunk_id, score, rank): expansion, cut at 3 * limit, weighing by type, cut at limit.

    ``among`` (chunk_id) filters what was reached before the first cut. With a known number of
    queries the few rows that are left go to all tasks.
    """
    best = expanded(seeds, edge_rows, hops=hops)
    if among is not None:
        best = best.join(among.select(F.col("chunk_id").cast("string").alias("chunk_id")), "chunk_id", "left_semi")
    cut = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "level", "chunk_id")
    )
    kept = best.withColumn("cut", cut).where(F.col("cut") <= OVER_FETCH * limit)
    typed = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "chunk_type", "name")
    weighed = (
        typed.join(sent(kept, n_queries and n_queries * OVER_FETCH * limit), "chunk_id")
        .withColumn("raw", F.col("score"))
        .withColumn("score", F.col("raw") * type_multiplier(F.col("chunk_type"), F.col("name")))
    )
    rank = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.round("raw", 9).desc(), "chunk_id")
    )
    ranked = weighed.withColumn("rank", rank.cast("int")).where(F.col("rank") <= limit)
    return normalised(ranked).select("query_id", "chunk_id", "score", "rank")


def is_ready(edge_rows: DataFrame) -> bool:
    return not edge_rows.where("resolved").limit(1).isEmpty()
