import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from lakeqa.llm import conversation_repair, queries

FIELDS = "conv_id long, turn long, role string, text string, cost string, Audit int, present boolean"
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """By search over all edits, cheapest and ASCII-least first; turns are (role, text, must go, truncated)."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, roles, kept = heapq.heappop(heap)
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, kept
        for role in ("user", "assistant"):
            if re.fullmatch("s?(ua)*u?", roles + role[0]) and not audit.endswith("II"):
                heapq.heappush(heap, (cost + 2, audit + "I", at, roles + role[0], (*kept, f"{role}:")))
        if at == len(turns):
            continue
        role, text, must_go, truncated = turns[at]
        heapq.heappush(heap, (cost + 3, audit + "D", at + 1, roles, kept))
        if must_go:
            continue
        for edit, price, new in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
            if new[:1] in ("s", "u", "a") and re.fullmatch("s?(ua)*u?", roles + new[0]):
                heapq.heappush(heap, (cost + price + truncated, audit + edit, at + 1, roles + new[0], (*kept, f"{new}:{text}")))
    raise AssertionError


def expected(rows):
    groups = defaultdict(list)
    for conv_id, turn, role, text, *rest in rows:
        groups[conv_id]
        if rest[-1]:
            groups[conv_id].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv_id, turns in groups.items():
        same = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), same(r)))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, marked, counts, illegal = set(), [], [0, 0, 0], 0
        for place, (_, role, text) in enumerate(turns):
            bare = text.rstrip(BLANKS)
            faults = (not bare, (role, text) in seen, bare[-1:] not in (".", "!", "?"))
            first = faults.index(True) if any(faults) else None
            if first is not None:
                counts[first] += 1
            seen.add((role, text))
            marked.append((role, text, first in (0, 1), int(first == 2)))
            illegal += place > 0 and turns[place - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit, kept = cheapest(marked)
        out.append((conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    turns = spark.createDataFrame(rows, FIELDS)
    return sorted(map(tuple, conversation_repair.repair(turns, present="present").collect()), key=repr)


def row(conv_id, turn, role, text, present=True):
    return (conv_id, turn, role, text, "x", 1, present)


CASES = [
    row(1, 0, "user", "A."), row(1, 1, "assistant", "B."),
    row(2, 0, "user", "A."), row(2, 0, "user", "A."), row(2, 3, "assistant", "cut"),
    row(3, None, "system", "S."), row(3, None, None, "odd."), row(3, 5, "user", None), row(3, 5, "User", "x!"),
    row(4, 1, "assistant", "gone", False),
    row(None, 2, "assistant", "\x0b\t"), row(None, 1, "user", "é?"), row(None, None, "", "empty role."),
    row(5, 0, "system", "S."), row(6, 7, "assistant", "A."), row(7, 0, "user", "\xa0"), row(8, 0, "user", ""),
    row(9, 0, "user", "Q."), row(9, 1, "user", "Q2"), row(9, 2, "system", "S"), row(9, 9, "assistant", "Q."),
]


def test_cases(spark):
    assert found(spark, CASES) == expected(CASES)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_random_conversations(spark):
    draw, rows = random.Random(11), []
    for conv_id in range(400):
        for turn in range(draw.randrange(6)):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "bot", "u2"])
            rows.append(row(conv_id, draw.choice([turn, turn, None]), role, draw.choice(["a.", "b", "", "c!", "d?"]), draw.random() < 0.95))
    assert found(spark, rows) == expected(rows)


def by_steps(signs):
    """Cost and ASCII-least edits by a plain forward table of every turn."""
    ways = {conversation_repair.START: (0, "")}
    def inserted(ways):
        out = dict(ways)
        for _ in range(2):
            for state, (cost, audit) in list(out.items()):
                too = conversation_repair.AFTER_FORCED[state]
                out[too] = min(out.get(too, (cost + 2, audit + "I")), (cost + 2, audit + "I"))
        return out
    for sign in signs:
        new = {}
        for state, (cost, audit) in inserted(ways).items():
            for letter, price, too in conversation_repair.choices(sign, state):
                new[too] = min(new.get(too, (1 << 60, "")), (cost + price, audit + letter))
        ways = new
    ends = inserted(ways)
    return min(ends[s] for s in (conversation_repair.START, conversation_repair.ASSISTANT) if s in ends)


@pytest.mark.parametrize("longest", [3, 70, 1000])
def test_runs_equal_single_steps(longest):
    draw = random.Random(longest)
    transitions = conversation_repair.Transitions()
    for _ in range(30):
        solver, signs = conversation_repair.Repair(transitions), []
        for _ in range(draw.randrange(5)):
            signs += [draw.randrange(9)] * draw.randrange(1, longest)
        for sign in signs:
            solver.add(sign)
        cost, edits = solver.solve()
        assert (cost, edits.decode()) == by_steps(signs)


def test_very_long_run_takes_few_steps():
    solver = conversation_repair.Repair(conversation_repair.Transitions())
    solver.signs.append(2), solver.counts.append(1 << 40)
    assert solver.transitions.before(2, 1 << 40, conversation_repair.ENDING)[0] == 1 << 40  # every second one changes its role
    assert len(solver.transitions.kept) == 41


def test_repaired_turns(spark):
    turns = spark.createDataFrame(CASES, FIELDS)
    rows = conversation_repair.repaired_turns(turns, present="present").orderBy("conv_id", "place").collect()
    texts = defaultdict(list)
    for r in rows:
        assert r["place"] == len(texts[r["conv_id"]])
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv_id, *_, digest in found(spark, CASES):
        assert hashlib.sha256("\n".join(texts[conv_id]).encode()).hexdigest() == digest


def test_damage_follows_the_contract(spark):
    rows = [row(c, t, "assistant", "One. Two!") for c in range(40) for t in (0, 1, None)] + [row(None, 3, None, None)]
    kept = defaultdict(list)
    for r in queries.damage(spark.createDataFrame(rows, FIELDS)).collect():
        kept[r["conv_id"], r["turn"]].append((r["role"], r["text"], r["present"]))
    for conv_id, turn, role, text, *_ in rows:
        role, text = role or " ", text or " "
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        one = ("user" if kind == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text), kind != 0)
        assert kept[conv_id, turn] == [one] * (2 if kind == 3 else 1)
