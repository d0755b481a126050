"""Chat formatting with minimum-cost role repair.

A legal conversation is at most one system turn, then user and assistant in turn, the last one an
assistant. Dynamic programming over the automaton of legal turns finds the cheapest repair of a
conversation's rows: a row is kept (free), joined to the turn before it (MERGE), given another role
(RELABEL, may be combined with joining), or has an empty turn put in front of it (INSERT); an empty
turn may also end the conversation (INSERT). Equal costs go to the earlier entry of OPTIONS, then to the
smaller state, so the result is unique.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any length spreads over
tasks. A task cuts its rows into segments of at most ``segment`` rows of one conversation and computes, for
every state before and after a segment, the cheapest way through (a matrix product in (min, +)), and the
repairs on it. Only conversations that have several segments need another step: it puts their matrices
together, one small row per segment, and picks the states between them.

The result has one row per given row, with the piece of the formatted text it contributes; pieces in the order
of (part, place) end to end are the formatted conversations. Rows of a conversation are ordered by turn, null
last, then role and text. Roles compare in lower case; null or unknown ones must be relabelled. Null texts are
empty. Rows with a null conv_id form one conversation. The marks ``<|`` in texts are broken up.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import small_batches
from logquarry.session import stage

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the last turn's role
MERGE, RELABEL, INSERT = 1, 2, 3
FAR = 1 << 40
#: What may follow each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Cost of ending in each state, and the empty turns that takes.
CLOSING = {START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}
#: (state before, role given, joined, empty turn before or None)
OPTIONS = (
    [(s, q, False, None) for s in LEGAL for q in LEGAL[s]]
    + [(q, q, True, None) for q in (SYSTEM, USER, ASSISTANT)]
    + [(s, q, False, x) for s in LEGAL for x in LEGAL[s] if x != SYSTEM for q in LEGAL[x]]
)


def _steps(role: str | None) -> list[list[tuple[int, int]]]:
    """For a row of this role: by state before and after, the cheapest cost and its option."""
    table = [[(FAR, -1)] * 4 for _ in range(4)]
    for at, (before, q, joined, empty) in enumerate(OPTIONS):
        cost = (0 if ROLES[q - 1] == role else RELABEL) + joined * MERGE + (empty is not None) * INSERT
        table[before][q] = min(table[before][q], (cost, at))
    return table


STEPS = {role: _steps(role) for role in (*ROLES, None)}


def _known(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def solve(roles: list[str | None], starts: list[int]) -> tuple[list[list[int]], list[list[list[int]]]]:
    """For each state in ``starts``: costs of ending in each state, and for each of these the rows' options."""
    costs, options = [], []
    for start in starts:
        now = [FAR] * 4
        now[start] = 0
        back = []
        for role in roles:
            table, new, how = STEPS[role], [FAR] * 4, [(-1, -1)] * 4
            for before in range(4):
                if now[before] < FAR:
                    for after in range(4):
                        cost = now[before] + table[before][after][0]
                        if cost < new[after]:
                            new[after], how[after] = cost, (before, table[before][after][1])
            back.append(how)
            now = new
        costs.append(now)
        paths = []
        for end in range(4):
            path, state = [], end
            if now[end] < FAR:
                for how in reversed(back):
                    state, option = how[state]
                    path.append(option)
            paths.append(path[::-1])
        options.append(paths)
    return costs, options


def best_end(costs: list[int]) -> int:
    return min(range(4), key=lambda s: (costs[s] + CLOSING[s][0], s))


def _between(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states before and after each segment of one conversation."""
    pdf = pdf.sort_values(["part", "seq"])
    matrices = [[list(r[i : i + 4]) for i in range(0, 16, 4)] for r in pdf["matrix"]]
    now, back = [0, FAR, FAR, FAR], []
    for m in matrices:
        new, how = [FAR] * 4, [0] * 4
        for before in range(4):
            for after in range(4):
                cost = now[before] + m[before][after]
                if cost < new[after]:
                    new[after], how[after] = cost, before
        back.append(how)
        now = new
    ends = [best_end(now)]
    for how in reversed(back):
        ends.append(how[ends[-1]])
    ends.reverse()
    return pd.DataFrame({"part": pdf["part"], "seq": pdf["seq"], "state": [4 * a + b for a, b in zip(ends, ends[1:])],
                         "last": [False] * (len(matrices) - 1) + [True]})


SEGMENTS = ("conv_id long, turn long, role string, text string, part int, place long, seq long, options array<int>, "
            "matrix array<long>, first boolean, last boolean")


def repair(conversations: DataFrame, segment: int = 2_048) -> DataFrame:
    """conv_id, turn, role, new_role, action, cost, piece, part, place of every row."""
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(),
             F.xxhash64("text").asc()]
    shape = conversations.sparkSession.createDataFrame([], SEGMENTS).schema

    def segments(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part = to_arrow_schema(shape), TaskContext.get().partitionId()
        place, seq, held, opened = 0, 0, [], False  # opened: the conversation began before these rows, or may have
        first_of_part = True

        def flush(ends: bool):
            """ends: the next row, if any, is another conversation's, and it is in this task."""
            nonlocal place, seq, held
            roles = [_known(r["role"]) for r in held]
            whole = ends and not opened
            costs, options = solve(roles, [START] if whole else [START, SYSTEM, USER, ASSISTANT])
            if whole:
                chosen, matrix = [[o] for o in options[0][best_end(costs[0])]], None
            else:
                matrix = [c for row in costs for c in row]
                chosen = [[p[i] if p else -1 for paths in options for p in paths] for i in range(len(held))]
            out = [{**r, "part": part, "place": place + i, "seq": seq, "options": chosen[i], "matrix": matrix if i == 0 else None,
                    "first": i == 0, "last": i == len(held) - 1} for i, r in enumerate(held)]
            place, seq, held = place + len(held), seq + 1, []
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["conv_id"] != held[0]["conv_id"] or len(held) >= segment):
                    other = r["conv_id"] != held[0]["conv_id"]
                    opened = opened or first_of_part
                    yield flush(other)
                    first_of_part, opened = False, not other
                held.append(r)
        if held:
            opened = opened or first_of_part
            yield flush(False)

    dealt = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(segments, shape))
    joints = dealt.where("matrix is not null").select("conv_id", "part", "seq", "matrix")
    states = stage(joints.groupBy("conv_id").applyInPandas(_between, "part int, seq long, state int, last boolean")
                   .withColumnRenamed("last", "ends"))
    alone = dealt.where(F.size("options") == 1).select("*", F.get("options", F.lit(0)).alias("option"), F.lit(True).alias("ends"))
    joined = dealt.where(F.size("options") > 1).join(states, ["part", "seq"]).select(
        *dealt.columns, F.get("options", F.col("state")).alias("option"), "ends")
    picked = alone.union(joined)
    table = F.array(*[F.struct(F.lit(before).alias("before"), F.lit(q).alias("role"), F.lit(joined_).alias("merged"),
                               F.lit(ROLES[empty - 1] if empty else None).cast("string").alias("empty"))
                      for before, q, joined_, empty in OPTIONS])
    o, names = F.get(table, F.col("option")), F.array(*[F.lit(r) for r in ROLES])
    new_role = F.get(names, o["role"] - 1)
    end, opening = F.lit("<|end|>\n"), lambda role: F.concat(F.lit("<|"), role, F.lit("|>\n"))
    body = F.replace("text", F.lit("<|"), F.lit("< |"))
    starts = F.concat(F.when(o["before"] == START, "").otherwise(end),
                      F.coalesce(F.concat(opening(o["empty"]), end), F.lit("")), opening(new_role))
    closes = F.when(F.col("last") & F.col("ends"), F.concat(end, F.when(
        F.col("closing") == SYSTEM, F.concat(opening(F.lit("user")), end, opening(F.lit("assistant")), end)).when(
        F.col("closing") == USER, F.concat(opening(F.lit("assistant")), end)).otherwise(""))).otherwise("")
    relabelled = F.coalesce(F.lower(F.trim("role")) != new_role, F.lit(True))
    cost = (F.when(relabelled, RELABEL).otherwise(0) + F.when(o["merged"], MERGE).otherwise(0)
            + F.when(o["empty"].isNotNull(), INSERT).otherwise(0)
            + F.when(F.col("last") & F.col("ends"), F.when(F.col("closing") == SYSTEM, 2 * INSERT).when(
                F.col("closing") == USER, INSERT).otherwise(0)).otherwise(0))
    action = F.concat_ws("+", F.when(o["empty"].isNotNull(), F.concat(F.lit("insert "), o["empty"])),
                         F.when(relabelled, F.lit("relabel")), F.when(o["merged"], F.lit("merge")))
    return picked.withColumn("closing", o["role"]).select(
        "conv_id", "turn", "role", new_role.alias("new_role"), F.when(action == "", "keep").otherwise(action).alias("action"),
        cost.cast("long").alias("cost"),
        F.concat(F.when(o["merged"], F.lit("\n")).otherwise(starts), body, closes).alias("piece"), "part", "place")
