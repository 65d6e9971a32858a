import json
import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import bpe, edits

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


def test_counts_equal_a_full_recount():
    rng, own, counter = random.Random(0), library(), edits.Counter(bpe.vocabulary(PATH))
    parts = ["a", "b", " ", "  ", "\n", "é", "'s", "'ll", "'", "r", "1", "<|endoftext|>", "!", " the", "\t", "—", "日本", " word", "ing"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 30, 300, 900])))
        tree = next(edits.trees([text], counter))
        for _ in range(rng.randint(1, 5)):
            start = rng.randint(0, len(text) + 2)
            end, new = start + rng.choice([0, 0, 1, 3, 50, 2000]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 0, 1, 4, 80])))
            want = text[:start] + new + text[end:]
            text, tree, _ = edits.edit(text, tree, start, end, new, counter)
            assert text == want and tree.total == len(own.encode(text, add_special_tokens=False).ids) and tree.chars[1] == len(text)


def test_a_small_edit_encodes_a_small_region():
    counter = edits.Counter(bpe.vocabulary(PATH))
    text = "some words to count " * 5_000
    tree = next(edits.trees([text], counter))
    text, tree, again = edits.edit(text, tree, 50_000, 50_003, "xyz", counter)
    assert again < 1_000 and tree.total == len(library().encode(text, add_special_tokens=False).ids)


def test_edges(spark, docs, edge_rows, nothing):
    changes = json.dumps([{"start": 0, "end": 3, "replacement": "new "}, None, {"start": None, "end": 1, "replacement": "x"}, {"start": 99999999, "end": 99999999}])
    got = edits.recounted(docs(edge_rows).withColumn("edits", F.from_json(F.lit(changes), edits.EDITS))).collect()
    own = library()
    want = []
    for i, text, _ in edge_rows:
        text = text or ""
        after = "new " + text[3:]
        want.append((i, len(own.encode(text, add_special_tokens=False).ids), 2, len(own.encode(after, add_special_tokens=False).ids), len(after)))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert edits.recounted(nothing.withColumn("edits", F.expr("CAST(NULL AS array<struct<start:bigint,end:bigint,replacement:string>>)"))).count() == 0


def test_edits_from_a_table(spark, docs):
    table = spark.createDataFrame([(1, 1, 0, 1, "B"), (1, 0, 0, 0, "A"), (3, 0, 0, 0, "x")], "doc_id long, place long, start long, end long, replacement string")
    rows = edits.with_edits(docs([(1, "text", None), (2, "other", None)]), table)
    got = {r.doc_id: (r.n_edits, r.edited_chars) for r in edits.recounted(rows).collect()}
    assert got == {1: (2, 5), 2: (0, 5)}
