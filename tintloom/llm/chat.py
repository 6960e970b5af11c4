"""Chat formatting with minimum-cost role repair.

A legal conversation may begin with a system turn; then user and assistant turns alternate, and an assistant turn
comes last. Dynamic programming over that automaton finds the cheapest repair of a conversation's roles: keep a turn,
relabel it, merge it into the turn before, or insert empty turns. The repaired sequence is rendered turn by turn.

Costs are of ``COSTS``. Among repairs of equal cost the one is taken whose states are smallest (start, system, user,
assistant), compared from the last turn backward. The order of turns is: turn number, role, hash of the text.

The result has a row for each turn, whose ``fragment`` texts, in the order of ``seq``, are the rendered conversation;
so a conversation of any length, even a third of all rows, is never gathered. Turns are ordered by range partitioning
and repaired in blocks. Where a conversation spans blocks, the costs between its block's states (a 4 x 4 matrix) are
combined on the driver: two small rows a block, and blocks are bounded in number.

Nulls: a null conv_id is a conversation of its own; a null turn comes before all others; a null or unknown role costs
``unknown`` whatever it becomes; a null text counts as empty. Rows that repeat a conversation, turn, role and text
are one turn, delivered several times (``copies`` tells how often). Markers in texts are escaped. An empty table gives
an empty result. Texts of any length are rendered whole. Only the four named columns are read, whatever others there are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, materialize, table

COSTS = {"merge": 1, "insert": 3, "relabel": 4, "unknown": 2}
STATES = ("start", "system", "user", "assistant")
# What may follow each state, and where a conversation may end.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
LAST = 3
FAR = 1 << 60
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


class Automaton:
    """Costs of moving from state to state over a turn of each role, with what is done on the way."""

    def __init__(self, costs: dict[str, int]):
        self.costs = costs
        # cheapest insertions between states: cost and inserted roles
        self.inserts = {q: self._paths(q) for q in NEXT}
        #: Cost of ending after a state, and the turns inserted for that.
        self.ends = [self.inserts[q].get(LAST, (FAR, ())) if q != LAST else (0, ()) for q in NEXT]
        self.tables = {role: self._table(role) for role in range(4)}
        self.steps: dict = {}

    def _paths(self, start: int) -> dict[int, tuple[int, tuple[int, ...]]]:
        found, edge = {start: (0, ())}, [start]
        while edge:
            new = []
            for q in edge:
                for s in NEXT[q]:
                    if s not in found:
                        found[s] = (found[q][0] + self.costs["insert"], (*found[q][1], s))
                        new.append(s)
            edge = new
        return found

    def _label(self, role: int, state: int) -> int:
        return self.costs["unknown"] if role == 0 else 0 if role == state else self.costs["relabel"]

    def _table(self, role: int) -> list[list[tuple[int, bool, tuple[int, ...]]]]:
        """[state before][state after]: cost, whether merged, inserted roles. Role 0 is unknown."""
        out = [[(FAR, False, ())] * 4 for _ in range(4)]
        for q in NEXT:
            for s in (1, 2, 3):
                options = [(cost + self._label(role, s), False, path) for via, (cost, path) in self.inserts[q].items() if s in NEXT[via]]
                if s == q:
                    options.append((self.costs["merge"] + self._label(role, s), True, ()))
                out[q][s] = min(options, key=lambda o: (o[0], len(o[2]), o[1]), default=out[q][s])
        return out

    def step(self, before: tuple, role: int) -> tuple[tuple, int, tuple]:
        """Costs after a turn, less their least, that least, and for each state the state before. Kept once found."""
        key = before, role
        if key not in self.steps:
            costs, come = [], []
            for s in range(4):
                options = [(before[q] + self.tables[role][q][s][0], q) for q in range(4)]
                cost, q = min(options)
                costs.append(min(cost, FAR))
                come.append(q)
            least = min(costs)
            self.steps[key] = tuple(c - least if c < FAR else FAR for c in costs), least, tuple(come)
        return self.steps[key]

    def forward(self, entry: tuple, roles: list[int]) -> tuple[tuple, int, list[tuple]]:
        """Costs after all turns, less a shift; the shift; and each turn's states before."""
        now, shift, come = entry, 0, []
        for role in roles:
            now, more, back = self.step(now, role)
            shift += more
            come.append(back)
        return now, shift, come

    def matrix(self, roles: list[int]) -> list[int]:
        """Least costs between the states before and after the turns, 16 numbers by rows."""
        out = []
        for q in range(4):
            now, shift, _ = self.forward(tuple(0 if i == q else FAR for i in range(4)), roles)
            out += [c + shift if c < FAR else FAR for c in now]
        return out

    def best_end(self, costs: tuple) -> int:
        return min(range(4), key=lambda s: (costs[s] + self.ends[s][0], s))


def role_codes(roles) -> list[int]:
    return [STATES.index(r) if r in STATES[1:] else 0 for r in roles]


BEGIN = (0, FAR, FAR, FAR)
SLIM = "conv long, turn long, role string, h long, copies long, part int"
ACTIONS = "conv long, turn long, role string, h long, copies long, seq long, action string, new_role string, inserted string, appended string"


def _segments(rows: pd.DataFrame):
    """The conversations of a block, each with its rows in order."""
    rows = rows.sort_values(["conv", "turn", "role", "h"], kind="stable")
    at = rows.conv.to_numpy()
    edges = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
    return [(int(at[a]), rows.iloc[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _spanning(blocks: DataFrame, auto: Automaton) -> dict:
    """For each (block, conversation) of a conversation in several blocks: entry costs, exit state, turns before, last."""

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        parts = _segments(rows)
        ends = parts if len(parts) < 2 else [parts[0], parts[-1]]
        return pd.DataFrame([(int(rows.part.iloc[0]), conv, len(own), auto.matrix(role_codes(own.role))) for conv, own in ends], columns=["part", "conv", "n", "matrix"])

    found: dict[int, list] = {}
    for r in blocks.groupBy("part").applyInPandas(summary, "part int, conv long, n long, matrix array<long>").collect():
        found.setdefault(r["conv"], []).append((r["part"], r["n"], r["matrix"]))
    chains = {conv: sorted(parts) for conv, parts in found.items() if len(parts) > 1}
    if not chains:
        return {}
    entry, before = {}, {}
    ends: dict[int, int] = {}
    for conv, parts in chains.items():
        now, seen = list(BEGIN), 0
        for part, n, matrix in parts:
            least = min(now)
            now = [c - least if c < FAR else FAR for c in now]
            entry[part, conv], before[part, conv] = tuple(now), seen
            now = [min(min(now[q] + matrix[4 * q + s], FAR) for q in range(4)) for s in range(4)]
            seen += n
        ends[conv] = auto.best_end(tuple(now))

    def trace(rows: pd.DataFrame) -> pd.DataFrame:
        part, out = int(rows.part.iloc[0]), []
        for conv, own in _segments(rows):
            if (part, conv) in entry:
                come = auto.forward(entry[part, conv], role_codes(own.role))[2]
                back = []
                for s in range(4):
                    for states in reversed(come):
                        s = states[s]
                    back.append(s)
                out.append((part, conv, back))
        return pd.DataFrame(out, columns=["part", "conv", "back"])

    some = blocks.where(F.col("part").isin(sorted({p for p, _ in entry})) & F.col("conv").isin(sorted(chains)))
    back = {(r["part"], r["conv"]): r["back"] for r in some.groupBy("part").applyInPandas(trace, "part int, conv long, back array<int>").collect()}
    context = {}
    for conv, parts in chains.items():
        state = ends[conv]
        for k, (part, _, _) in enumerate(reversed(parts)):
            context[part, conv] = entry[part, conv], state, before[part, conv], k == 0
            state = back[part, conv][state]
    return context


def actions(turns: DataFrame, *, costs: dict[str, int] | None = None, block: int = 5_000, most_blocks: int = 20_000) -> DataFrame:
    """Rows of ``ACTIONS``: what is done with each distinct turn (conv, turn, role, h)."""
    auto = Automaton({**COSTS, **(costs or {})})
    slim = materialize(turns.groupBy("conv", "turn", "role", "h").agg(F.count("*").alias("copies")), "turns")
    n = max(1, min(most_blocks, -(-slim.count() // block)))
    blocks = materialize(slim.repartitionByRange(n, "conv", "turn", "role", "h").withColumn("part", F.spark_partition_id()), "blocks")
    context = _spanning(blocks, auto)

    def repair(rows: pd.DataFrame) -> pd.DataFrame:
        part, out = int(rows.part.iloc[0]), []
        for conv, own in _segments(rows):
            roles = role_codes(own.role)
            entry, state, before, last = context.get((part, conv), (BEGIN, None, 0, True))
            now, _, come = auto.forward(entry, roles)
            state = auto.best_end(now) if state is None else state
            path = [state]
            for states in reversed(come):
                path.append(states[path[-1]])
            path.reverse()
            for k, (role, row) in enumerate(zip(roles, own.itertuples(index=False), strict=True)):
                cost, merged, added = auto.tables[role][path[k]][path[k + 1]]
                same = role == path[k + 1]
                action = ("merge" if merged else "keep") if same else ("merge+relabel" if merged else "relabel")
                appended = auto.ends[path[-1]][1] if last and k + 1 == len(roles) else None
                out.append((conv, row.turn, row.role, row.h, row.copies, before + k, action, STATES[path[k + 1]], ",".join(STATES[s] for s in added), None if appended is None else ",".join(STATES[s] for s in appended)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ACTIONS.split(", ")])

    # a number given here keeps small blocks from being put into a few tasks
    return blocks.repartition(n, "part").groupBy("part").applyInPandas(repair, ACTIONS)


def _empties(column: str):
    """Rendered empty turns of a list of roles."""
    return F.when(F.col(column) == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(column, ","), lambda r: F.concat(F.lit(OPEN), r, F.lit("\n" + CLOSE))), ""))


def format_chat(conversations: DataFrame, **options) -> DataFrame:
    """Rows (conv_id, turn, role, seq, copies, action, new_role, inserted, appended, fragment), one for each distinct turn.

    appended is null but for a conversation's last turn, where it names the turns inserted behind it.
    """
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NO_ID)).alias("turn"),
        F.coalesce(F.lower(F.trim(F.col("role").cast("string"))), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    key = ["conv", "turn", "role", "h"]
    done = materialize(actions(turns.select(*key), **options), "actions")
    rows = turns.dropDuplicates(key).join(done, key)
    text = F.regexp_replace("text", r"<\|(im_start|im_end)\|>", r"<\\|$1|>")
    opened = F.concat(F.when(F.col("seq") > 0, F.lit(CLOSE)).otherwise(F.lit("")), _empties("inserted"), F.lit(OPEN), "new_role", F.lit("\n"), text)
    begun = F.when(F.col("action").startswith("merge"), F.concat(F.lit("\n\n"), text)).otherwise(opened)
    ended = F.when(F.col("appended").isNotNull(), F.concat(F.lit(CLOSE), _empties("appended"))).otherwise(F.lit(""))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select(back("conv").alias("conv_id"), back("turn").alias("turn"), "role", "seq", "copies", "action", "new_role", "inserted", "appended", F.concat(begun, ended).alias("fragment"))


def op1_chat_format(spark, sf_dir):
    return format_chat(table(spark, sf_dir, "conversations"))
