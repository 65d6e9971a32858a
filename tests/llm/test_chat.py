import hashlib
import json

import pytest

from tablewright.llm import chat

TURNS = "conv_id long, turn long, role string, text string, `place` string, `piece` string, `formatted` string"


def read(turns):
    return {r.conv_id: r for r in chat.read_back(chat.formatted(turns)).collect()}


def plain(row):
    return [(t.role, t.text) for t in row.turns]


def test_edges_read_back(spark):
    hard = "\\ <s> </s> [ROLE] [/ROLE] [INST] <\\s> <<s> \\\\ [[ROLE]] 🙂 \n end\\"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "assistant", None), (2, 0, None, None), (2, 1, "</s>", "x")]
    rows += [(3, None, "user", "first"), (3, 5, "b", "tie"), (3, 5, "a", "tie"), (3, 5, "a", "tie"), (None, 0, "assistant", "no id")]
    got = read(chat.canonical(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)))
    assert plain(got[1]) == [("user", hard), ("assistant", hard), ("assistant", "")] and got[1].loss_texts == [hard, ""]
    assert plain(got[2]) == [("", ""), ("</s>", "x")] and got[2].loss_texts == []
    assert plain(got[3]) == [("user", "first"), ("a", "tie"), ("a", "tie"), ("b", "tie")]
    assert got[None].loss_texts == ["no id"]
    assert not read(chat.canonical(spark.createDataFrame([], TURNS)))


def test_each_layout_is_found_by_its_fingerprint(spark):
    two = [("user", "q"), ("assistant", "a")]
    tables = [
        ("conv_id long, messages array<struct<role:string,content:string>>", (1, two), two),
        ("conv_id long, conversations array<struct<`from`:string,value:string>>", (1, [("human", "q"), ("gpt", "a")]), two),
        ("conv_id long, prompt string, response string", (1, "q", "a"), two),
        ("conv_id long, prompt string, completion string, extra string", (1, "q", "a", "x"), two),
        ("conv_id long, system string, prompt string, response string", (1, "s", "q", "a"), [("system", "s"), *two]),
        ("conv_id long, instruction string, input string, output string", (1, "q", "", "a"), two),
    ]
    for schema, row, want in tables:
        assert plain(read(chat.canonical(spark.createDataFrame([row], schema)))[1]) == want
    assert len({layout.fingerprint for layout in chat.LAYOUTS}) == len(chat.LAYOUTS)
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, "x")], "conv_id long, other string"))


def test_records_of_mixed_layouts(spark):
    two = [("user", "q"), ("assistant", "a")]
    records = [
        (1, json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3})),
        (3, json.dumps({"instruction": "q", "output": "a"})),
        (4, json.dumps({"prompt": "q", "response": "a", "lang": "en"})),
        (5, "not json"),
        (6, None),
        (7, json.dumps({"unknown": 1})),
    ]
    got = read(chat.canonical_records(spark.createDataFrame(records, "conv_id long, record string")))
    assert {i: plain(r) for i, r in got.items()} == dict.fromkeys((1, 2, 3, 4), two)


def test_mask_covers_each_assistant_text_once(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", f"text {i} é</s>") for i in range(50)]
    texts = chat.formatted(chat.canonical(spark.createDataFrame([(*r, "", "", "") for r in rows], TURNS))).collect()[0]
    cut = [texts.formatted[s.start : s.start + s.length] for s in texts.loss_spans]
    assert [c.replace("<\\/s>", "</s>") for c in cut] == [r[3] for r in rows if r[2] == "assistant"]
    assert hashlib.sha256("".join(cut).encode()).hexdigest()


def test_records_that_fit_no_layout_exactly_keep_their_turns(spark):
    two = [("user", "q"), ("assistant", "a")]
    call = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    records = [
        (1, {"system": "s", "prompt": "q", "completion": "a"}, two),
        (2, {"prompt": "q", "response": "a", "input": "i"}, two),
        (3, {"messages": [{"role": "assistant", "content": None}, *call]}, [("assistant", ""), *two]),
        (4, {"messages": [{"role": "system"}, *call, None, "odd"]}, [("system", ""), *two, ("", ""), ("", "")]),
        (5, {"prompt": "q", "response": None}, [("user", "q"), ("assistant", "")]),
        (6, {"role": "assistant", "text": "a", "turn": 2}, two),
        (6, {"role": "user", "text": "q", "turn": 1}, None),
        (7, {"messages": []}, None),
        (8, {"unknown": 1}, None),
    ]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v, _ in records], "conv_id long, record string")
    turns = chat.canonical_records(rows)
    assert {i: plain(r) for i, r in read(turns).items()} == {i: want for i, _, want in records if want}
    empty = turns.where("place IS NULL").collect()
    assert sorted(tuple(r) for r in empty) == [(7, None, None, None), (8, None, None, None)]
