from collections import Counter

from cases import SCHEMA, letters, odd_documents
from test_near_copies import roots

import __spark_entry__
import corpus_pipeline
from rankfield.llm import queries


def folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def corpus():
    filler = lambda i: "\n".join(" ".join(letters(i, j, k) for k in range(25)) for j in range(4))
    rows = [(i, filler(i), "en", f"s{i % 3}", 1, "", "", "") for i in range(60)]
    rows += [(100 + i, filler(i).replace("a", "A"), "en", "s0", 1, "", "", "") for i in range(5)]
    rows += [(200, "too short", "en", "s0", 1, "", "", ""), (201, None, "en", "s1", None, "", "", "")]
    return rows


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mixing", "packing"]
    assert "pipeline" in __spark_entry__.queries() and set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    path = folder(spark, tmp_path, corpus())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "packing":
            assert docs.columns == columns, name
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert ids[0] == {*range(60), *range(100, 105)}, "short and null documents go, others stay"
    assert ids[1] == ids[0]
    assert ids[2] == ids[3] == ids[4] == set(range(60)), "near copies go, one of each group stays"


def test_near_duplicate_stage_matches_brute_force(spark, tmp_path):
    path = folder(spark, tmp_path, odd_documents())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = docs.collect()
    label = roots([r.text for r in rows])
    want = Counter(min((r.doc_id for r, c in zip(rows, label, strict=True) if c == g and r.doc_id is not None), default=None) for g in set(label))
    assert Counter(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, path).collect()) == want


def test_whole_run_equals_the_stages_one_by_one(spark, tmp_path):
    path = folder(spark, tmp_path, corpus() + odd_documents())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/stage-{n}")
        docs = spark.read.parquet(f"{path}/stage-{n}")
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, path).collect()) == Counter(tuple(r) for r in docs.collect())


def test_run_over_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).count() == 0
