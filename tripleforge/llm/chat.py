"""Chat formatting: the cheapest repair of a conversation's roles, by dynamic programming over legal turns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize

#: The states: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
#: Other names of roles.
ALIASES = {"ai": "assistant", "bot": "assistant", "gpt": "assistant", "human": "user", "model": "assistant"}
#: Which turn may follow which state, and in which state a conversation may end.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
END = ASSISTANT
MERGE, RELABEL, INSERT = 1, 2, 3
#: Turns and bytes of text of a segment at most; a longer conversation is several segments.
SEGMENT_TURNS, SEGMENT_BYTES = 4_096, 4 << 20
INFINITE = 10**9


def _between(state: int, role: int) -> list[int] | None:
    """The shortest sequence of empty turns that lets role follow state."""
    paths, seen = [(state, [])], set()
    while paths:
        at, path = paths.pop(0)
        if role in LEGAL[at]:
            return path
        for step in LEGAL[at]:
            if step not in seen:
                seen.add(step)
                paths.append((step, [*path, step]))
    return None


def _moves() -> list[list[list[tuple[int, tuple]]]]:
    """For each role of a turn (START: an unknown one), each state before and each state after: the least cost and its edit."""
    table = []
    for role in range(4):
        rows = []
        for state in range(4):
            row: list[tuple[int, tuple]] = [(INFINITE, ())]
            for to in (SYSTEM, USER, ASSISTANT):
                label = 0 if role == to else RELABEL
                path = _between(state, to)
                best = (label + INSERT * len(path), ("turn", tuple(path), to, label > 0)) if path is not None else (INFINITE, ())
                if to == state and label + MERGE < best[0]:
                    best = (label + MERGE, ("merge", (), to, label > 0))
                row.append(best)
            rows.append(row)
        table.append(rows)
    return table


MOVES = _moves()
COSTS = np.array([[[c for c, _ in row] for row in rows] for rows in MOVES], dtype=np.int64)
#: Empty turns that end a conversation from each state.
CLOSING = {s: ([] if s == END else [*(_between(s, END) or []), END]) for s in range(4)}


def role_state(role: str | None) -> int:
    """The state that a role's name stands for; START for a null or unknown one."""
    name = (role or "").strip().lower()
    return ROLES.get(ALIASES.get(name, name), START)


def segment_costs(roles: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Least costs from each state before the turns to each state after them, and the order of the states before.

    Of several states before with equal costs in all, the one of the lowest order for a state after begins the
    way that `repair` takes through the whole conversation: the way through the lowest states from the end.
    """
    total, order = np.where(np.eye(4, dtype=bool), 0, INFINITE), np.tile(np.arange(4)[:, None], (1, 4))
    entry = np.arange(4)[:, None]
    for role in roles:
        through = total[:, :, None] + COSTS[role][None]
        before = through.argmin(axis=1)
        total = np.minimum(through.min(axis=1), INFINITE)
        order = (before * 4 + order[entry, before]).argsort(axis=0, kind="stable").argsort(axis=0)
    return total, order


def least_costs(roles: list[int]) -> list[int]:
    """Least costs from nothing to each state after the turns."""
    cost = [0, INFINITE, INFINITE, INFINITE]
    for role in roles:
        moves = MOVES[role]
        cost = [INFINITE, *(min(INFINITE, *(cost[s] + moves[s][to][0] for s in range(4))) for to in (SYSTEM, USER, ASSISTANT))]
    return cost


_MARK, _MARKED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    """text with a backslash more in each <|, so that no text reads as a mark; `unescape` undoes it."""
    return _MARK.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def repair(roles: list[int], entry: int, last: int) -> tuple[int, list[tuple]]:
    """The cost and edits of the cheapest way from entry to last; of equals, the one through the lowest states from the end."""
    cost = [INFINITE] * 4
    cost[entry] = 0
    back: list[list[int]] = []
    for role in roles:
        moves = MOVES[role]
        now, origin = [INFINITE] * 4, [0] * 4
        for to in (SYSTEM, USER, ASSISTANT):
            for state in range(4):
                c = cost[state] + moves[state][to][0]
                if c < now[to]:
                    now[to], origin[to] = c, state
        cost = now
        back.append(origin)
    edits, at = [], last
    for role, origin in zip(reversed(roles), reversed(back), strict=True):
        edits.append(MOVES[role][origin[at]][at][1])
        at = origin[at]
    return cost[last], edits[::-1]


def render(edits: list[tuple], texts: list[str | None], entry: int, closing: list[int] | None) -> str:
    """The text of a segment: what stands between its first turn's mark and its last; the conversation's last segment closes it."""
    out: list[str] = []
    is_open = entry != START
    for (kind, path, to, _), text in zip(edits, texts, strict=True):
        if kind == "merge":
            out.append("\n" + escape(text or ""))
            continue
        for role, body in (*((r, "") for r in path), (to, escape(text or ""))):
            out.append(("<|end|>\n" if is_open else "") + f"<|{NAMES[role]}|>\n{body}")
            is_open = True
    if closing is not None:
        out += [f"<|end|>\n<|{NAMES[role]}|>\n" for role in closing]
        out.append("<|end|>\n")
    return "".join(out)


OUT = "piece int, n_turns bigint, cost bigint, n_merged bigint, n_relabelled bigint, n_inserted bigint, rendered string"


def format_chats(conversations: DataFrame, id_column: str = "conv_id", segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """(id, piece, n_turns, cost, n_merged, n_relabelled, n_inserted, rendered) of every conversation.

    A legal conversation has at most one system turn, at its start, then user and assistant turns in
    alternation, and ends with the assistant. Each turn is kept, relabelled or merged with the turn before it,
    and empty turns are inserted; the sequence of edits with the least total cost is found by dynamic
    programming over the last turn's role, of equal ones the one through the lowest states from the end.
    rendered has a mark before and after every turn; in texts, what would read as a mark is escaped.

    A conversation longer than a segment is several pieces, whose texts put together in order are the whole;
    their edits are those of the whole conversation's cheapest repair: each segment's costs between states
    are a small matrix, the matrices of a conversation are put together first, and segments are then
    repaired from the state in which they begin to the one in which they end. So one conversation may hold
    any share of all rows. Turns are in the order of turn, role and text, nulls first; null and unknown roles
    cost a relabelling; null texts are empty; rows without an id are one conversation; repeated rows are
    turns of their own. Other columns are not read; an empty table gives an empty result.
    """
    kind = dict(conversations.dtypes)[id_column]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("_id", "turn", "role", "text")]
    rows = conversations.select(F.col(id_column).alias("_id"), "turn", "role", "text")
    ranged = rows.repartitionByRange(n, F.col("_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first(), F.col("text").asc_nulls_first())
    dealt = ranged.sortWithinPartitions(*order).select("_id", "role", "text", F.spark_partition_id().alias("part"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        names, texts, size, number, part = [], [], 0, 0, 0

        whole = False  # whether the conversation of this segment cannot be in others: it begins and ends within this partition

        def row(last: bool) -> tuple:
            costs, ways = ([], []) if whole and not last else (x.ravel().tolist() for x in segment_costs([role_state(r) for r in names]))
            return held[0], part * 2**32 + number, list(names), list(texts), costs, ways

        schema = pa.schema([("_id", id_type), ("segment", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("costs", pa.list_(pa.int64())), ("ways", pa.list_(pa.int64()))])
        done: list[tuple] = []
        weight = 0
        for batch in batches:
            for key, role, text, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (key != held[0] or len(names) >= segment_turns or size >= SEGMENT_BYTES):
                    done.append(row(key == held[0]))
                    whole = key != held[0]
                    weight += size
                    number += 1
                    names, texts, size = [], [], 0
                    if len(done) >= 2_000 or weight >= SEGMENT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                        done, weight = [], 0
                held[:] = [key]
                part = p
                names.append(role)
                texts.append(text)
                size += len(text or "")
        if names:
            done.append(row(True))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    id_type = to_arrow_type(rows.schema["_id"].dataType)
    cut = materialize(dealt.mapInArrow(segments, f"_id {kind}, segment bigint, roles array<string>, texts array<string>, costs array<bigint>, ways array<bigint>"), "chat")
    # conversations of several segments: their matrices only, at most one for SEGMENT_TURNS turns or SEGMENT_BYTES of text
    counts = cut.groupBy(F.col("_id").alias("_many")).agg(F.count("*").alias("n")).where("n > 1")
    several = cut.select("_id", "segment", "costs", "ways").join(counts, F.col("_id").eqNullSafe(F.col("_many")), "left_semi")

    def chained(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("segment")
        states, back = np.array([0, INFINITE, INFINITE, INFINITE]), []
        for costs, ways in zip(group["costs"], group["ways"], strict=True):
            through = states[:, None] + np.asarray(costs).reshape(4, 4)
            back.append(np.where(through == through.min(axis=0), np.asarray(ways).reshape(4, 4), 4).argmin(axis=0))
            states = np.minimum(through.min(axis=0), INFINITE)
        at = int(np.argmin([states[s] + INSERT * len(CLOSING[s]) for s in range(4)]))
        out = []
        for origin in reversed(back):
            out.append((int(origin[at]), at))
            at = int(origin[at])
        out.reverse()
        last = [i == len(out) - 1 for i in range(len(out))]
        return pd.DataFrame({"segment": group["segment"].to_numpy(), "piece": range(len(out)), "entry": [a for a, _ in out], "exit": [b for _, b in out], "is_last": last})

    chain = several.groupBy("_id").applyInPandas(chained, "segment bigint, piece int, entry int, exit int, is_last boolean")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for roles, texts, piece, entry, last, is_last in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                states = [role_state(r) for r in roles]
                if piece is None:
                    piece, entry, is_last = 0, START, True
                    costs = least_costs(states)
                    last = int(np.argmin([costs[s] + INSERT * len(CLOSING[s]) for s in range(4)]))
                cost, edits = repair(states, entry, last)
                closing = CLOSING[last] if is_last else None
                inserted = sum(len(e[1]) for e in edits) + len(closing or [])
                out.append((piece, len(states), cost + INSERT * len(closing or []), sum(e[0] == "merge" for e in edits), sum(e[3] for e in edits), inserted, render(edits, texts, entry, closing)))
            types = [pa.int32(), *[pa.int64()] * 5, pa.string()]
            columns = [list(x) for x in zip(*out, strict=True)] or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[id_column, "piece", "n_turns", "cost", "n_merged", "n_relabelled", "n_inserted", "rendered"])

    joined = cut.join(chain, "segment", "left").select("_id", "roles", "texts", "piece", "entry", "exit", "is_last")
    return joined.mapInArrow(repaired, f"`{id_column}` {kind}, {OUT}")
