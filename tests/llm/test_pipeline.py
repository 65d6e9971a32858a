from collections import Counter

import corpus_pipeline
from tablewright.llm import hyperminhash, mixing, toxicity
from tablewright.llm.common import read_table
from tests_llm_tables import SF_DIR, needs_tables


@needs_tables
def test_stages_take_effect(spark):
    docs = read_table(spark, SF_DIR, "documents")
    clean = corpus_pipeline.without_toxic(spark, docs, SF_DIR).cache()
    scores = toxicity.scores(docs, toxicity.fit(docs, read_table(spark, SF_DIR, "labels"))).collect()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in scores if r.score < 0.5)
    toxic = {r.doc_id for r in read_table(spark, SF_DIR, "labels").collect() if r.toxic == 1}
    assert len(toxic - {r.doc_id for r in clean.collect()}) >= 0.8 * len(toxic)

    single = corpus_pipeline.without_near_duplicates(spark, clean, SF_DIR).cache()
    found = hyperminhash.near_duplicates(clean, width=5).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in found})

    mix = corpus_pipeline.mixed_sources(spark, single, SF_DIR).cache()
    copies = {r.doc_id: r.copies for r in mixing.copies(single).collect()}
    assert Counter(r.doc_id for r in mix.collect()) == Counter({i: n for i, n in copies.items() if n})
    for part in (clean, single, mix):
        assert part.columns == docs.columns
    out = corpus_pipeline.encoded(spark, mix, SF_DIR)
    assert out.count() == mix.count() and [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "bpe"]


def test_stages_on_edges_and_nothing(spark, edges, nothing, tmp_path):
    spark.createDataFrame([(20, 1), (21, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (edges, nothing):
        for _, step in corpus_pipeline.STAGES:
            rows = step(spark, rows, str(tmp_path))
        rows.count()
