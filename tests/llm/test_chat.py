import itertools
import random
import re

import pytest

from pitlake.llm import chat


def written(plan):
    """Roles of the repaired conversation."""
    out = []
    for role, action, chain in plan:
        out += list(chain)
        if not action.endswith("merge"):
            out.append(role)
    return out


def cost(turns, plan):
    return sum((chat.RELABEL + (r == chat.SYSTEM) if r != x else 0) + (chat.MERGE if a.endswith("merge") else 0) + chat.INSERT * len(c) for x, (r, a, c) in zip(turns, plan))


def legal(roles):
    body = roles[1:] if roles[:1] == [chat.SYSTEM] else roles
    return all(r == (chat.USER, chat.ASSISTANT)[i % 2] for i, r in enumerate(body))


def cheapest(turns):
    """Least cost over all roles, merges and insertions before each turn."""
    best = 1 << 30
    for roles in itertools.product((1, 2, 3), repeat=len(turns)):
        for how in itertools.product((None, (), (2,), (3,)), repeat=len(turns)):
            out, total, ok = [], 0, True
            for x, r, h in zip(turns, roles, how):
                total += chat.RELABEL + (r == chat.SYSTEM) if x != r else 0
                if h is None:
                    ok &= bool(out) and out[-1] == r
                    total += chat.MERGE
                else:
                    total += chat.INSERT * len(h)
                    out += [*h, r]
            if ok and total < best and legal(out):
                best = total
    return best


def test_repair_is_legal_and_cheapest():
    for n in range(4):
        for turns in itertools.product(range(4), repeat=n):
            plan = chat.repair(list(turns))
            assert legal(written(plan)) and (not n or cost(turns, plan) == cheapest(turns)), turns


def test_matrices_chain():
    rng = random.Random(1)
    for _ in range(50):
        turns = [rng.randrange(4) for _ in range(rng.randint(2, 12))]
        k = rng.randint(1, len(turns) - 1)
        a, b, whole = chat.matrix(turns[:k]), chat.matrix(turns[k:]), chat.matrix(turns)
        for s in range(4):
            for e in range(4):
                assert min(whole[4 * s + e], 1 << 40) == min(1 << 40, *(a[4 * s + m] + b[4 * m + e] for m in range(4)))


@pytest.mark.parametrize("block", [1, 3, 512])
def test_formatting(spark, block):
    rng = random.Random(9)
    rows, want = [], {}
    for conv in range(40):
        turns = [rng.choice(["user", "assistant", "system", " User", None, "tool"]) for _ in range(rng.randint(1, 9))]
        rows += [(conv, i, r, f"text {conv} {i}", "x") for i, r in enumerate(turns)]
        want[conv] = cost([chat.role_number(r) for r in turns], chat.repair([chat.role_number(r) for r in turns]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    got = chat.format_chats(df, block=block)
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append(r)
    assert sum(map(len, by.values())) == len(rows)
    for conv, out in by.items():
        given = [chat.role_number(r) for c, _, r, _, _ in rows if c == conv]
        plan = [(chat.ROLES.index(r.role), r.action, [chat.ROLES.index(x) for x in r.inserted]) for r in out]
        assert legal(written(plan)) and cost(given, plan) == want[conv]
        text = "".join(r.rendered for r in out)
        assert text.count("<|end|>") == len(written(plan)) == text.count("<|") - text.count("<|end|>")
        assert all(f"text {conv} {i}" in text for i in range(len(out)))
    whole = {r.conv_id: r.text for r in chat.conversations(got).collect()}
    assert whole == {c: "".join(r.rendered for r in out) for c, out in by.items()}


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, 5, "assistant", None), (1, 5, "assistant", "b"), (1, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.format_chats(df).collect(), key=lambda r: (str(r.conv_id), r.turn or -1, r.n))
    assert [(r.conv_id, r.turn, r.n, r.role, r.action) for r in got] == [(1, None, 0, "user", "keep"), (1, 5, 0, "assistant", "keep"), (1, 5, 1, "assistant", "merge"), (None, None, 0, "user", "relabel")]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_many_rows_of_one_turn_number_are_cut(spark):
    rng = random.Random(4)
    rows = [(None, None, rng.choice(["user", "assistant"]), f"t{i}") for i in range(300)] + [(1, i % 3, "user", f"u{i}") for i in range(100)] + [(2, 0, "user", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    role_of = {t: x for _, _, x, t in rows}

    def check(found):
        """Texts in order and the cost of each conversation."""
        out = {}
        for r in sorted(found, key=lambda r: (str(r.conv_id), -1 if r.turn is None else r.turn, r.n)):
            out.setdefault(r.conv_id, []).append((re.search(r"\b[tu]\d+|alone", r.rendered)[0], r))
        for conv, found in out.items():
            plan = [(chat.ROLES.index(r.role), r.action, [chat.ROLES.index(x) for x in r.inserted]) for _, r in found]
            assert legal(written(plan))
            out[conv] = [t for t, _ in found], cost([chat.role_number(role_of[t]) for t, _ in found], plan)
        return out

    small, whole = chat.format_chats(df, block=8).collect(), chat.format_chats(df).collect()
    assert sorted(r.n for r in small if r.conv_id is None) == list(range(300))
    assert check(small) == check(whole)


@pytest.mark.parametrize("block", [4, 512])
def test_repeated_rows_are_turns_of_their_own(spark, block):
    rows = [(1, 0, "user", "hi")] * 50 + [(1, 1, "assistant", "yes")] * 3 + [(None, None, None, None)] * 30 + [(2, 0, "user", f"t{i % 3}") for i in range(60)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), block=block).collect()
    assert len(got) == len(rows)
    for conv in (1, None, 2):
        out = sorted((r for r in got if r.conv_id == conv), key=lambda r: (-1 if r.turn is None else r.turn, r.n))
        plan = [(chat.ROLES.index(r.role), r.action, [chat.ROLES.index(x) for x in r.inserted]) for r in out]
        given = [chat.role_number(r[2]) for r in sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])]
        assert legal(written(plan)) and cost(given, plan) == cost(given, chat.repair(given))
        assert [r.n for r in out if r.turn in (0, None)] == list(range(sum(r[0] == conv and r[1] in (0, None) for r in rows)))
    assert sum(r.rendered.count("hi") for r in got) == 50 and sum(r.rendered.count("t1") for r in got) == 20
