import random
import re

import pytest

from tablewright.llm import licenses


def brute(text, percent=80, span=32):
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    best, labels = 0.0, set()
    for start in range(0, max(len(words) - span, 1), span):
        block = set(words[start : start + 2 * span])
        for label, notice in licenses.TEMPLATES:
            held = set(licenses.plain_words(notice))
            common = len(block & held)
            if 100 * common >= percent * len(held):
                labels.add(label)
                best = max(best, common / len(held))
    starts = [s for s, _ in places]
    base = {label for _, label in places}
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best,
    )


def texts():
    rng = random.Random(2)
    notices = [notice for _, notice in licenses.TEMPLATES]
    filler = ["the", "of", "is", "software", "permission", "version", "under", "license", "and", "é", "mit", "x1", "free"]
    out = [None, "", " .,;", "under the MIT license", "CC BY-NC cc by nc: cc-by-nc/cc", "apache license, version 2.0", "Under the mİt license"]
    for _ in range(150):
        words = [rng.choice(filler) for _ in range(rng.randrange(0, 150))]
        notice = rng.choice(notices).split()
        lost = rng.randrange(0, 6)
        for _ in range(lost):
            notice.pop(rng.randrange(len(notice)))
        at = rng.randrange(len(words) + 1)
        out.append(rng.choice([" ", "\n", ", "]).join(words[:at] + notice + words[at:]))
    out.append(" ".join(rng.choice(filler) for _ in range(30_000)) + " " + notices[4])
    return out


def flat(df):
    return sorted((tuple(r) for r in licenses.summary(df).collect()), key=repr)


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_equals_brute_force(spark, docs, percent):
    rows = [(i, text, "s") for i, text in enumerate(texts())]
    got = flat(licenses.scan(docs(rows), percent=percent))
    assert got == sorted([(i, *brute(text, percent)) for i, text, _ in rows], key=repr)


def test_edges(spark, docs, edges, edge_rows, nothing):
    more = [(None, "Released under the MIT License.", None), (1, "under the mit license", "s"), (1, "under the mit license", "s")]
    got = flat(licenses.scan(docs(edge_rows + more)))
    assert got == sorted([(i, *brute(text)) for i, text, _ in edge_rows + more], key=repr)
    assert flat(licenses.scan(nothing)) == []
    with pytest.raises(ValueError):
        licenses.scan(nothing, templates=(("long", "word " * 40),))


def test_no_python_in_the_plan(spark, docs):
    plan = licenses.summary(licenses.scan(docs([(1, "a", "s")])))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_blocks_are_named(docs):
    text = "w " * 100 + licenses.TEMPLATES[4][1]
    found = licenses.scan(docs([(1, text, "s")])).collect()[0]
    assert {n.label for n in found.notices} == {"gpl"} and {n.block for n in found.notices} <= {2, 3}
