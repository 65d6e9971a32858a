import random
import re
import zlib
from collections import Counter

import pytest

from tablewright.llm import spelling


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(rows, rare=97):
    counts = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % rare == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms, out = {}, {}
    for w, n in words.items():
        others = sorted((-words[o], o) for o in words if near(w, o))
        leads = others and -others[0][0] >= 2 * n
        forms[w] = others[0][1] if leads else None
        out[w] = [forms[w], None, n, len(others), -others[0][0] if leads else None]
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def made():
    rng = random.Random(4)
    stems = ["begin", "tionally", "tionalle", "größe", "Écoles", "écoles", "straße", "aaaaaa", "aaaaa", "aaaaaaa", "×÷ùúû", "abcdeabcde"]
    words = [*stems]
    for stem in stems:
        for _ in range(12):
            i = rng.randrange(len(stem))
            words += [stem[:i] + stem[i + 1 :], stem[:i] + rng.choice("abé") + stem[i:], stem[:i] + rng.choice("xyÿ") + stem[i + 1 :]]
    rows = [(i, " ".join(rng.choice(words[: 1 + rng.randrange(len(words))]) + rng.choice(["", ".", "7", "日"]) for _ in range(60)), "s") for i in range(120)]
    long = "z" * 3_000
    rows += [(900 + i, f"{long} {long}y {long}x ab{'q' * 80} ab{'q' * 81} ac{'q' * 80}", "s") for i in range(3)]
    return rows + [(None, "begin begin", None), (1, None, "s"), (2, "", "s"), (3, "begin", "s"), (3, "begin", "s")]


def found(df, **options):
    return {r.word: tuple(r)[1:] for r in spelling.variants(df, **options).collect()}


@pytest.mark.parametrize("tile", [3, 1024])
def test_equals_brute_force(docs, tile):
    rows = made()
    want = brute(rows, rare=5)
    assert found(docs(rows).repartition(3), tile=tile, rare=5) == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] != v[1] for v in want.values() if v[0])


def test_edges(edges, edge_rows, nothing):
    assert found(edges) == brute(edge_rows)
    assert found(nothing) == {}


def test_one_draw_for_all_occurrences_of_a_document(docs):
    letters = "abcdefghijklmnopqrstuvwxyz"
    run = next(r for r in ("abcdef" + c + d for c in letters for d in letters) if zlib.crc32(f"7:{r}".encode()) % 97 == 0)
    assert found(docs([(7, f"{run} {run.upper()} {run}", "s")])) == brute([(7, f"{run} {run} {run}", "s")])
    assert len(next(iter(brute([(7, f"{run} {run} {run}", "s")])))) == 7
