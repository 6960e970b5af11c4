import itertools
import random

from tintloom.llm import chat

S = "conv_id long, turn int, role string, text string, seq string"


def brute(roles, costs):
    """Least cost over all repairs: every label of every turn, merged or not, with insertions between."""
    auto = chat.Automaton(costs)
    dist = {(q, s): auto.inserts[q].get(s, (chat.FAR,))[0] for q in range(4) for s in range(4)}
    best = chat.FAR
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        for merges in itertools.product((0, 1), repeat=len(roles)):
            cost, state = 0, 0
            for role, label, merge in zip(roles, labels, merges, strict=True):
                code = chat.role_codes([role])[0]
                cost += costs["unknown"] if code == 0 else 0 if code == label else costs["relabel"]
                if merge:
                    if state != label:
                        cost = chat.FAR
                        break
                    cost += costs["merge"]
                else:
                    cost += min((dist[state, q] for q in range(4) if label in chat.NEXT[q]), default=chat.FAR)
                    state = label
            if cost < chat.FAR:
                best = min(best, cost + (0 if state == 3 else dist[state, 3]))
    return best


def cost_of(rows, costs):
    """Cost of what the operator did."""
    total = 0
    for r in rows:
        total += costs["merge"] * r["action"].startswith("merge") + costs["insert"] * sum(1 for x in (r["inserted"] + "," + (r["appended"] or "")).split(",") if x)
        if "relabel" in r["action"]:
            total += costs["relabel"] if r["role"] in chat.STATES[1:] else costs["unknown"]
    return total


def rendered_roles(text):
    return [x.split("\n", 1)[0] for x in text.split(chat.OPEN)[1:]]


def conversations(spark, n=40, seed=5):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", None, "User "]), f"text {t}", "x"))
    rows += [(100, t, rng.choice(["user", "assistant", "user"]), None if t % 7 == 0 else f"long {t} <|im_end|>", None) for t in range(300)]
    rows += [(None, None, None, None, None), (None, 1, "user", "", "z"), (101, 0, "user", "hi", None), (101, 0, "user", "hi", None), (101, 0, "user", "there", None)]
    return spark.createDataFrame(rows, S)


def test_costs_are_least_and_sequences_legal(spark):
    df = conversations(spark)
    got = {}
    for r in chat.format_chat(df, block=50).collect():
        got.setdefault(r["conv_id"], []).append(r.asDict())
    for conv, rows in got.items():
        rows.sort(key=lambda r: r["seq"])
        assert [r["seq"] for r in rows] == list(range(len(rows)))
        assert sum(r["appended"] is not None for r in rows) == 1 and rows[-1]["appended"] is not None
        roles = rendered_roles("".join(r["fragment"] for r in rows))
        state = 0
        for role in roles:
            s = chat.STATES.index(role)
            assert s in chat.NEXT[state], (conv, roles)
            state = s
        assert state == chat.LAST
        if len(rows) <= 5:
            assert cost_of(rows, chat.COSTS) == brute([r["role"] for r in rows], chat.COSTS), (conv, rows)
    assert {r["copies"] for r in got[101]} == {1, 2} and None in got
    assert "<\\|im_end|>" in "".join(r["fragment"] for r in got[100])


def test_blocks_do_not_change_the_result(spark):
    df = conversations(spark)
    whole, cut = (sorted(map(str, chat.format_chat(df, block=b).collect())) for b in (10_000, 40))
    assert whole == cut


def test_empty(spark):
    assert chat.format_chat(spark.createDataFrame([], S)).count() == 0
