import hashlib
import random

import pytest

from tablewright.llm import structure

TURNS = "conv_id long, turn long, role string, text string, piece string, `at` string, audit string, _id string"
STATES = {"s": {"0": "S"}, "u": {"0": "U", "S": "U", "A": "U"}, "a": {"U": "A"}}
ONWARD = {"0": "U", "S": "U", "U": "A", "A": "U"}
NAMES = {"U": "user", "A": "assistant"}


def brute(rows):
    """Forward search over all states, least cost first, then the ASCII-least audit."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marks = set(), []
    for _, role, text in rows:
        solid = text.strip(structure.SPACE)
        marks.append("b" if not solid else "d" if (role, text) in seen else "." if solid[-1] in ".!?" else "t")
        seen.add((role, text))

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                way = (cost + 5, audit + "I", lines + [NAMES[ONWARD[state]] + ":"])
                best[ONWARD[state]] = min(best.get(ONWARD[state], way), way)
        return best

    best = with_inserts({"0": (0, "", [])})
    for (_, role, text), mark in zip(rows, marks):
        after = {}
        for state, (cost, audit, lines) in best.items():
            ways = [(state, (cost + 2, audit + "D", lines))]
            if mark in ".t":
                extra = 5 * (mark == "t")
                kept = STATES.get(role[:1], {}).get(state)
                if kept:
                    ways.append((kept, (cost + extra, audit + "K", lines + [f"{role}:{text}"])))
                ways.append((ONWARD[state], (cost + extra + 1, audit + "R", lines + [f"{NAMES[ONWARD[state]]}:{text}"])))
            for onward, way in ways:
                after[onward] = min(after.get(onward, way), way)
        best = with_inserts(after)
    cost, audit, lines = min(best[s] for s in "0A" if s in best)
    turns = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] if r[1][:1] in tuple("sua") else "x" for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], TURNS)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(12)]:
        words = ["yes.", "no!", "cut off", "", " \t\n", "why?  \n", "é", "cut off\x0b", "ok. 🙂"]
        for i in range(rng.choice([1, 2, 3, 9, 40])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""])
            text = rng.choice(words) + rng.choice(["", "", f" {i}."])
            rows.append((conv, rng.choice([i, i, i + 3, None]), role, text))
    # what passes a speculative vector on unchanged: rows to delete and truncated rows
    rows += [(50, i, "user", "") for i in range(60)] + [(51, i, "user", f"cut {i}") for i in range(60)]
    rows += [(52, 0, "system", "s.")] + [(52, i, "tool", f"cut {i}") for i in range(1, 40)] + [(52, 41, "assistant", "a.")]
    rows += [(53, 0, "user", "same.")] * 30 + [(54, None, "assistant", "." * 300_000)]
    return rows


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role or " ", text or " ") if role is None or text is None else (turn, role, text))
    return {conv: brute(part) for conv, part in convs.items()}


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_equals_brute_force_whatever_the_chunks(spark, bits):
    rows = made(bits)
    got = {r[0]: tuple(r)[1:] for r in structure.report(table(spark, rows).repartition(3), bits=bits).collect()}
    assert got == expected(rows)


def test_nulls_ties_repeats_and_nothing(spark):
    rows = [(1, None, None, None), (1, None, "user", None), (1, 0, None, "hi."), (2, 5, "user", "a."), (2, 5, "user", "a."), (2, 5, "assistant", "b.")]
    got = {r[0]: tuple(r)[1:] for r in structure.report(table(spark, rows), bits=1).collect()}
    assert got == expected(rows)
    nothing = structure.report(table(spark, []))
    assert nothing.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert nothing.count() == 0 and structure.repair(table(spark, [])).count() == 0


def test_repaired_rows_are_those_of_the_digest(spark):
    rows = made(7)
    lines = {}
    for r in sorted(structure.repair(table(spark, rows), bits=2).collect(), key=lambda r: (r.piece, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert (r.edit == "I") <= (r.turn is None and r.text == "")
    want = expected(rows)
    for conv, result in want.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == result[-1]


def test_bounds_hold_for_every_vector():
    rng, vector = random.Random(3), structure.END
    for _ in range(20_000):
        assert all(vector[s] <= vector[t] + structure.BOUNDS[s][t] for s in range(4) for t in range(4))
        vector = structure.END if rng.random() < 0.05 else structure.back(rng.choice("suaxSUAXd"), vector)[1]


def test_passes_are_few_where_chunks_never_converge(spark, monkeypatch):
    labels = []
    real = structure.stage
    monkeypatch.setattr(structure, "stage", lambda df, label="stage": labels.append(label) or real(df, label))
    rows = [(1, i, "user", f"cut {i}") for i in range(64)]
    found = structure.report(table(spark, rows), bits=0).collect()
    assert found[0].cost == 128 and found[0].audit == "D" * 64
    assert labels.count("vectors") <= 8  # 64 chunks
