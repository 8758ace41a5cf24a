"""Chat formatting by minimum-cost role repair.

A conversation is legal when it is an optional system message, then user and assistant
messages in turn, ending with the assistant. Each turn may be kept, merged into the message
before it, relabelled, or preceded by inserted empty messages; dynamic programming over the
automaton's states finds the cheapest repair, which is then rendered.

Turns are sorted once over the whole cluster and cut into blocks of BLOCK rows. A block's part
of a conversation acts on the automaton as a small (min, +) matrix, so a conversation of any
length is solved from its blocks' matrices; no task holds more than a block of its turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import text_digest, written

ROLES = ("system", "user", "assistant")
#: States: 0 before any message, 1 + role after a message of that role.
N = 4
END = 3
KEEP, MERGE, RELABEL, INSERT = 0, 1, 4, 3
#: Relabelling a role that is null or not one of ROLES.
UNKNOWN = 1
BLOCK_BITS = 12
INFINITE = 1 << 40

_NEXT = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}  # legal next roles by state


def _inserts(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty messages that make ``role`` legal after ``state``."""
    ways = [(state, ())]
    for _ in range(3):
        for at, path in ways:
            if role in _NEXT[at]:
                return path
        ways = [(1 + r, (*path, r)) for at, path in ways for r in _NEXT[at]]
    return None


def _options(code: int) -> dict[tuple[int, int], tuple[int, int, tuple[int, ...]]]:
    """(state before, state after) -> (cost, merged, inserted roles) for a turn of role code; 3: unknown."""
    out: dict = {}
    for p in range(N):
        for role in range(3):
            label = KEEP if role == code else UNKNOWN if code == 3 else RELABEL
            ways = []
            if (path := _inserts(p, role)) is not None:
                ways.append((label + INSERT * len(path), 0, path))
            if p == 1 + role:
                ways.append((label + MERGE, 1, ()))
            for way in ways:
                if way < out.get((p, 1 + role), (INFINITE,)):
                    out[p, 1 + role] = way
    return out


OPTIONS = [_options(c) for c in range(4)]
CLOSING = [(INSERT * len(path), path) for path in ((), (1, 2), (2,), ())]
CLOSING[0] = (0, ())


def forward(codes: str, entry: list[int]) -> list[list[int]]:
    """Least cost of every state before each turn and at the end."""
    rows = [entry]
    for c in codes:
        now, after = rows[-1], [INFINITE] * N
        for (p, q), (cost, _, _) in OPTIONS[ord(c) - 48].items():
            if now[p] + cost < after[q]:
                after[q] = now[p] + cost
        rows.append(after)
    return rows


def backward(codes: str, rows: list[list[int]], state: int) -> list[int]:
    """The states before each turn and at the end of the cheapest path to ``state``; ties to lower states."""
    path = [state]
    for k in range(len(codes) - 1, -1, -1):
        options = OPTIONS[ord(codes[k]) - 48]
        best, q = INFINITE * 2, path[-1]
        for p in range(N):
            if (p, q) in options and rows[k][p] + options[p, q][0] < best:
                best, state = rows[k][p] + options[p, q][0], p
        path.append(state)
    return path[::-1]


START = [0] + [INFINITE] * (N - 1)


def last_state(costs: list[int]) -> int:
    return min(range(N), key=lambda s: (costs[s] + CLOSING[s][0], s))


def _unit(state: int) -> list[int]:
    return [0 if s == state else INFINITE for s in range(N)]


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in filter(len, batches):
        found = [[x for p in range(N) for x in forward(codes, _unit(p))[-1]] for codes in batch["codes"]]
        yield pd.DataFrame({"conv": batch["conv"], "block": batch["block"], "matrix": found})


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    """Least costs before each block of one conversation; the group has one short row a block."""
    group = group.sort_values("block")
    costs, out = list(START), []
    for matrix in group["matrix"]:
        out.append(costs)
        costs = [min(costs[p] + int(matrix[p * N + q]) for p in range(N)) for q in range(N)]
    group["entry"] = out
    group["final"] = last_state(costs)
    return group[["conv", "block", "entry", "final"]]


def _ways_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block and each state after it, the state before it on the cheapest path."""
    for batch in filter(len, batches):
        ways = []
        for codes, entry in zip(batch["codes"], batch["entry"]):
            rows = forward(codes, [int(x) for x in entry])
            ways.append([backward(codes, rows, q)[0] if rows[-1][q] < INFINITE else -1 for q in range(N)])
        yield pd.DataFrame({"conv": batch["conv"], "block": batch["block"], "final": batch["final"], "way": ways})


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("block", ascending=False)
    state, out = int(group["final"].iloc[0]), []
    for way in group["way"]:
        out.append(state)
        state = int(way[state])
    group["exit"] = out
    return group[["conv", "block", "exit"]]


def _decisions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in filter(len, batches):
        out = []
        for codes, entry, exit_ in zip(batch["codes"], batch["entry"], batch["exit"]):
            rows = forward(codes, START if entry is None else [int(x) for x in entry])
            path = backward(codes, rows, last_state(rows[-1]) if pd.isna(exit_) else int(exit_))
            turns = []
            for k, c in enumerate(codes):
                cost, merged, inserted = OPTIONS[ord(c) - 48][path[k], path[k + 1]]
                turns.append(f"{path[k]}{path[k + 1] - 1}{merged}{cost:02d}" + "".join(map(str, inserted)))
            out.append(turns)
        yield pd.DataFrame({"block": batch["block"], "conv": batch["conv"], "turns": out})


def _tag(role: str, open_: str, close: str):
    return f"{open_}{role}\n", close


def repaired(
    turns: DataFrame, open_tag: str = "<|im_start|>", close_tag: str = "<|im_end|>\n"
) -> DataFrame:
    """(conv_id, turn, role, text, new_role, action, inserted, cost, last, piece) for every row of ``turns``.

    ``turns`` has conv_id, turn, role, text. Rows are ordered by turn (nulls last), then role and
    the text's digest; repeated rows are separate turns. Null conversation ids form one
    conversation, null texts are empty, long texts stay whole, null and unknown roles may take any role at cost UNKNOWN. action is keep,
    merge, relabel or merge+relabel; inserted lists the roles of the empty messages before the
    turn. The pieces of a conversation, in order, are its rendered text.
    """
    known = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")), F.lit(0))
    code = F.when(known > 0, known - 1).otherwise(3).cast("string")
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    picked = turns.select(
        conv.alias("conv"), "conv_id", "turn", "role", "text", code.alias("code"), text_digest().alias("digest")
    )
    # The sort key ends with the text's digest: a long conversation, or many equal turn numbers, is
    # split, and no texts are sampled for the ranges.
    order = ["conv", F.col("turn").asc_nulls_last(), "role", "digest"]
    placed = picked.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.drop("digest").withColumn("id", F.monotonically_increasing_id())
    placed = written(placed.withColumn("block", F.shiftright("id", BLOCK_BITS)), "chat-turns")
    blocks = placed.groupBy("conv", "block").agg(
        F.min("id").alias("first"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("id", "code"))), lambda x: x["code"]), ""
        ).alias("codes"),
    )
    blocks = written(blocks, "chat-blocks")
    spread = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max("block").alias("last_block"))
    long_ = blocks.join(spread.where("n > 1").select("conv"), "conv")
    entries = long_.mapInPandas(_matrices, "conv string, block long, matrix array<long>")
    entries = entries.groupBy("conv").applyInPandas(_entries, "conv string, block long, entry array<long>, final int")
    entries = written(entries, "chat-entries")
    ways = long_.join(entries, ["conv", "block"]).mapInPandas(
        _ways_back, "conv string, block long, final int, way array<int>"
    )
    exits = ways.groupBy("conv").applyInPandas(_exits, "conv string, block long, exit int")
    solved = (
        blocks.join(entries.select("conv", "block", "entry"), ["conv", "block"], "left")
        .join(exits, ["conv", "block"], "left")
        .select("conv", "block", "codes", "entry", "exit")
        # Codes are small, so Spark would put all into one task; deciding is the work.
        .repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv", "block")
        .mapInPandas(_decisions, "block long, conv string, turns array<string>")
    )
    chosen = (
        solved.join(blocks.select("conv", "block", "first"), ["conv", "block"])
        .join(spread.select("conv", "last_block"), "conv")
        .select(
            (F.col("block") == F.col("last_block")).alias("in_last"),
            F.size("turns").alias("n"),
            "first",
            F.posexplode("turns").alias("at", "way"),
        )
        .select(
            (F.col("first") + F.col("at")).alias("id"),
            "way",
            (F.col("in_last") & (F.col("at") == F.col("n") - 1)).alias("last"),
        )
    )
    names = F.array(*map(F.lit, ROLES))
    joined = placed.join(chosen, "id")
    was = F.substring("way", 1, 1)
    new_role = F.element_at(names, F.substring("way", 2, 1).cast("int") + 1)
    merged = F.substring("way", 3, 1) == "1"
    inserted = F.transform(
        F.filter(F.split(F.substring("way", 6, 9), ""), lambda x: x != ""),
        lambda x: F.element_at(names, x.cast("int") + 1),
    )
    changed = ~F.coalesce(F.col("role") == new_role, F.lit(False))
    action = (
        F.when(merged & changed, "merge+relabel").when(merged, "merge").when(changed, "relabel").otherwise("keep")
    )

    def empty(roles):
        return F.array_join(
            F.transform(roles, lambda r: F.concat(F.lit(open_tag), r, F.lit("\n" + close_tag))), ""
        )

    close_before = F.when(was == "0", "").otherwise(close_tag)
    closing = {s: F.array(*[F.lit(ROLES[r]) for r in CLOSING[s][1]]) for s in (1, 2)}
    at_end = (
        F.when(~F.col("last"), "")
        .when(new_role == "system", F.concat(F.lit(close_tag), empty(closing[1])))
        .when(new_role == "user", F.concat(F.lit(close_tag), empty(closing[2])))
        .otherwise(close_tag)
    )
    head = F.when(merged, "\n").otherwise(
        F.concat(close_before, empty(inserted), F.lit(open_tag), new_role, F.lit("\n"))
    )
    piece = F.concat(head, F.coalesce("text", F.lit("")), at_end)
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "text",
        new_role.alias("new_role"),
        action.alias("action"),
        inserted.alias("inserted"),
        F.substring("way", 4, 2).cast("int").alias("cost"),
        "last",
        piece.alias("piece"),
    )


def rendered(turns: DataFrame, **tags: str) -> DataFrame:
    """(conv_id, rendered): whole conversations, for tables whose conversations fit a row."""
    found = repaired(turns, **tags)
    order = F.row_number().over(
        Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", text_digest())
    )
    parts = F.array_sort(F.collect_list(F.struct("at", "piece")))
    return (
        found.withColumn("at", order)
        .groupBy("conv_id")
        .agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("rendered"))
    )


def chat_query(spark, sf_dir: str) -> DataFrame:
    found = repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.select(
        "conv_id",
        "turn",
        "role",
        "new_role",
        "action",
        F.array_join("inserted", ",").alias("inserted"),
        "cost",
        "last",
        "piece",
    )
