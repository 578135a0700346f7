"""Chat formatting with repair of the turn order at least cost.

A conversation is legal when an optional system turn comes first and user and assistant turns then take each other's place, beginning with
the user and ending with the assistant. Every turn is kept under its own role, relabelled, or merged into the turn before it; empty turns
are put in where one is missing. An automaton with a state for the last role reads the turns; dynamic programming finds the cheapest way
through it, and the repaired turns are rendered with role marks.

The automaton has four states, so the best costs over a piece of a conversation are a 4 x 4 table, and tables of neighbouring pieces are
chained by minimum sums. A distributed running count cuts a conversation into pieces of ``PIECE`` turns: pieces are solved on their own, their
tables are chained level by level, ``PIECE`` at a time, and each piece then traces its own way between the states it was given. No group
holds more than ``PIECE`` turns or tables, however long a conversation is and whatever its turn numbers are. Only the last step
gathers a conversation, as its text is one value, which Spark limits to 2 GB; ``rendered_pieces`` has the same text as rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curlew.llm.registry import query, table
from curlew.operators.rowindex import with_row_index
from curlew.session import store

PIECE = 1024
ROLES = ("system", "user", "assistant")
#: Other names under which roles are known.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
MERGE, RELABEL, INSERT = 10, 15, 12  # costs of the repairs; keeping a turn is free
FOREVER = 10**9
#: The states that may follow each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _moves(role: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, action) of reading a turn whose own role is ``role`` (0: none that is known).

    An action is ``merge``, or ``put`` with the roles of the turns put in before it. Order decides between equal costs."""
    moves = []
    for state in range(STATES):
        if state != START:  # into the turn before; cheaper when the roles agree
            moves.append((state, state, MERGE if role == state else MERGE + RELABEL, "merge"))
        for target in (SYSTEM, USER, ASSISTANT):
            own = 0 if role == target else RELABEL
            if target in LEGAL[state]:
                moves.append((state, target, own, "put"))
            for middle in LEGAL[state]:
                if target in LEGAL[middle]:
                    moves.append((state, target, own + INSERT, f"put {ROLES[middle - 1]}"))
    return moves


MOVES = [_moves(role) for role in range(STATES)]
#: For each role, the least cost between two states.
COSTS = np.full((STATES, STATES, STATES), FOREVER, np.int64)
for _role, _list in enumerate(MOVES):
    for _from, _to, _cost, _ in _list:
        COSTS[_role, _from, _to] = min(COSTS[_role, _from, _to], _cost)
#: Cost of ending after each state: a missing answer is put in; a conversation without turns stays empty.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least costs over two pieces in a row."""
    return np.minimum((left[:, :, None] + right[None, :, :]).min(axis=1), FOREVER)


def piece_costs(roles: np.ndarray) -> np.ndarray:
    """Least costs of reading all turns of a piece between any two states."""
    out = np.full((STATES, STATES), FOREVER, np.int64)
    np.fill_diagonal(out, 0)
    for role in roles:
        out = chain(out, COSTS[role])
    return out


def trace(roles: np.ndarray, first: int, last: int) -> list[tuple[int, str]]:
    """(state after it, action) for each turn on the cheapest way from ``first`` to ``last``; of equal ways, the one whose turns come
    first in the list of moves, from the last turn back."""
    best = np.full((len(roles) + 1, STATES), FOREVER, np.int64)
    best[0, first] = 0
    for i, role in enumerate(roles):
        best[i + 1] = np.minimum((best[i][:, None] + COSTS[role]).min(axis=0), FOREVER)
    out, state = [], last
    for i in range(len(roles) - 1, -1, -1):
        for source, target, cost, action in MOVES[roles[i]]:
            if target == state and best[i, source] + cost == best[i + 1, state]:
                out.append((state, action))
                state = source
                break
    return out[::-1]


def escaped(text: Column) -> Column:
    """Text without any ``<|``, which marks begin with: one more backslash stands inside each, so ``plain`` gives the text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def plain(text: Column) -> Column:
    """The text of a turn as it was before ``escaped``."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation, 0 up, and their role's number."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in (ALIASES | {r: r for r in ROLES}).items() for x in pair])
    number = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.coalesce(known[role], F.lit("")))
    plain = turns.select("conv_id", "turn", number.cast("int").alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    return plain.filter(F.col("conv_id").isNotNull())


def _pieces(plain: DataFrame, piece: int) -> DataFrame:
    """Add ``at``, the turn's place in the order of all turns, and the piece it is in: ``piece`` turns of its conversation."""
    order = [F.col("conv_id"), *[F.col(c).asc_nulls_last() for c in ("turn", "role", "text")]]
    placed = with_row_index(plain, order, "at")
    firsts = placed.groupBy("conv_id").agg(F.min("at").alias("first_at"))
    return placed.join(firsts, "conv_id").withColumn("piece", F.floor((F.col("at") - F.col("first_at")) / piece)).drop("first_at")


def _ways(tables: DataFrame, piece: int) -> DataFrame:
    """(conv_id, piece, first, last, cost): the states before and behind each piece on the cheapest way, and the conversation's cost.

    Up to ``piece`` neighbouring tables become one of the next level until each conversation has one; the states then come down again."""
    fan = max(2, piece)
    levels = [tables]
    while not levels[-1].filter("piece > 0").isEmpty():

        def join_up(key, frame: pd.DataFrame) -> pd.DataFrame:
            parts = [np.array(c).reshape(STATES, STATES) for c in frame.sort_values("piece").costs]
            whole = parts[0]
            for part in parts[1:]:
                whole = chain(whole, part)
            return pd.DataFrame({"conv_id": [key[0]], "piece": [key[1]], "costs": [whole.ravel().tolist()]})

        above = levels[-1].groupBy("conv_id", F.floor(F.col("piece") / fan).alias("above")).applyInPandas(join_up, _TABLES)
        levels.append(store(above, "chat-costs"))

    def top(batches):
        for batch in batches:
            best = [np.array(c)[:STATES] + END for c in batch.costs]  # from the start
            last = [int(np.argmin(b)) for b in best]
            cost = [int(b.min()) for b in best]
            yield pd.DataFrame({"conv_id": batch.conv_id, "piece": batch.piece, "first": START, "last": last, "cost": cost})

    ways = levels[-1].mapInPandas(top, _WAYS)
    for below in reversed(levels[:-1]):

        def settle(key, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("piece")
            parts = [np.array(c).reshape(STATES, STATES) for c in frame.costs]
            end = np.full(STATES, FOREVER, np.int64)
            end[int(frame["last"].iloc[0])] = 0
            ahead = [end]  # least cost from each state behind a piece to the end
            for part in reversed(parts[1:]):
                ahead.append(np.minimum((part + ahead[-1][None, :]).min(axis=1), FOREVER))
            ahead.reverse()
            state, firsts, lasts = int(frame["first"].iloc[0]), [], []
            for part, rest in zip(parts, ahead, strict=True):
                firsts.append(state)
                state = int(np.argmin(part[state] + rest))
                lasts.append(state)
            return pd.DataFrame({"conv_id": key[0], "piece": frame.piece, "first": firsts, "last": lasts, "cost": frame.cost})

        held = ways.withColumnRenamed("piece", "above")
        parts = below.withColumn("above", F.floor(F.col("piece") / fan)).join(held, ["conv_id", "above"])
        ways = parts.groupBy("conv_id", "above").applyInPandas(settle, _WAYS)
    return ways


_TABLES = "conv_id bigint, piece bigint, costs array<bigint>"
_WAYS = "conv_id bigint, piece bigint, first int, last int, cost bigint"


def rendered_pieces(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, piece (0 up), n, merged, relabelled, inserted, body, last (state) and cost (the conversation's): a row per piece.

    ``turns`` as for ``repair``. The bodies of a conversation in the order of its pieces, less the first mark, are its text without the end."""
    numbered = store(_pieces(_numbered(turns), piece), "chat-turns")

    def solve(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        costs = piece_costs(frame.role.to_numpy())
        return pd.DataFrame({"conv_id": [key[0]], "piece": [key[1]], "costs": [costs.ravel().tolist()]})

    tables = store(numbered.groupBy("conv_id", "piece").applyInPandas(solve, _TABLES), "chat-costs")
    routed = numbered.join(store(_ways(tables, piece), "chat-ways"), ["conv_id", "piece"])

    def write(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        roles = frame.role.to_numpy()
        out, merged, relabelled, inserted = [], 0, 0, 0
        for own, text, (state, action) in zip(roles, frame.text, trace(roles, int(frame["first"].iloc[0]), int(frame["last"].iloc[0])), strict=True):
            relabelled += own != state
            if action == "merge":
                merged += 1
                out.append(f"\n{text}")
                continue
            for put in action.split()[1:]:
                inserted += 1
                out.append(f"<|end|>\n<|{put}|>\n")
            out.append(f"<|end|>\n<|{ROLES[state - 1]}|>\n{text}")
        row = {"conv_id": key[0], "piece": key[1], "n": len(frame), "merged": merged, "relabelled": int(relabelled), "inserted": inserted}
        return pd.DataFrame([row | {"body": "".join(out), "last": int(frame["last"].iloc[0]), "cost": int(frame["cost"].iloc[0])}])

    return routed.groupBy("conv_id", "piece").applyInPandas(
        write, "conv_id bigint, piece bigint, n bigint, merged bigint, relabelled bigint, inserted bigint, body string, last int, cost bigint"
    )


def repair(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, n_turns, cost, n_merged, n_relabelled, n_inserted and text (the rendered conversation), a row per conversation.

    ``turns`` has conv_id, turn (a whole number), role and text. Turns are read by number, null last, then role and text, so repeated rows are
    turns in a row. Roles are compared without case and blanks, by their other names too; any other role, or null, fits none and is
    relabelled. A null text is empty. ``<|`` in a text is written ``<\\|``, with one more backslash for those that stand there already, so
    that no text can pass for a mark. Rows with a null conv_id belong to no conversation and are left out. Other columns are not
    looked at; an empty table gives no rows. A text is one value, so it must stay below 2 GB; longer ones are in ``rendered_pieces``. Costs:
    MERGE, RELABEL and INSERT; of equal ways the first in the order of moves."""
    whole = rendered_pieces(turns, piece).groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.max("cost").alias("cost"),
        F.sum("merged").alias("n_merged"),
        F.sum("relabelled").alias("n_relabelled"),
        F.sum("inserted").alias("inserted"),
        F.array_sort(F.collect_list(F.struct("piece", "body", "last"))).alias("parts"),
    )
    last = F.element_at("parts", -1)["last"]
    ending = F.when(last == USER, "<|end|>\n<|assistant|>\n").when(last == SYSTEM, "<|end|>\n<|user|>\n<|end|>\n<|assistant|>\n").otherwise("")
    body = F.concat(F.array_join(F.transform("parts", lambda p: p["body"]), ""), ending, F.lit("<|end|>\n"))
    return whole.select(
        "conv_id",
        "n_turns",
        "cost",
        "n_merged",
        "n_relabelled",
        (F.col("inserted") + F.when(last == USER, 1).when(last == SYSTEM, 2).otherwise(0)).alias("n_inserted"),
        F.substring(body, len("<|end|>\n") + 1, (1 << 31) - 1).alias("text"),
    )


@query("op7_chat")
def op7_chat(spark, sf):
    return repair(table(spark, sf, "conversations"))
