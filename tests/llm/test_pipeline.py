"""The pipeline's rows against a plain Python version of its stages."""

import corpus_pipeline
from attestra.llm import source_mix
from tests.llm.test_brute_force import PATH, brute_groups
from tokenizers import Tokenizer


def test_pipeline(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    clean = corpus_pipeline.quality(spark, docs, d).collect()
    assert {r.doc_id for r in clean} <= {r.doc_id for r in docs.collect()}
    last = {}
    for r in clean:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    unique = [r for r in clean if last[r.text] == r.doc_id]
    stay = {i for i, _, c in brute_groups([(r.doc_id, r.text) for r in unique]) if i == c}
    left = spark.createDataFrame([r for r in unique if r.doc_id in stay], docs.schema)
    mixed = {r.doc_id: (r.taken // r.size, r.text) for r in source_mix.mix(left).collect() if r.taken}
    library = Tokenizer.from_file(PATH)
    want = sorted((i, tuple(library.encode(t, add_special_tokens=False).ids)) for i, (n, t) in mixed.items() for _ in range(n))
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == want


def test_stages_keep_columns(spark, hard, empty):
    for docs in (hard, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            out.count()
        assert corpus_pipeline.tokens(spark, docs, "").count() == docs.count()
