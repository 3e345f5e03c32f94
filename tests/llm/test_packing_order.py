"""Packing in the order of files that another writer named."""

from cases import frame, odd_documents

from rankfield.llm import packing


def test_follow_takes_files_of_any_name(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = [(i, f"word{i} " * (1 + i % 3), "en", "a", 1, "", "", "") for i in range(60)]
    whole = frame(spark, rows).coalesce(1).toArrow()
    for name, part in (("documents", whole.slice(0, 20)), ("more-a", whole.slice(20, 20)), ("part-0001", whole.slice(40, 20))):
        pq.write_table(part, f"{tmp_path}/{name}.parquet")
    found = packing.pack(spark.read.parquet(str(tmp_path)), follow=True, buckets=1, batch_tokens=30, shard_rows=7).collect()
    order = [r.doc_id for r in sorted(found, key=lambda r: (r.batch, r.slot))]
    assert sorted(order) == list(range(60)) and order[40:] == list(range(40, 60)), "files with a number come last, in order"
    assert {tuple(order[:20]), tuple(order[20:40])} == {tuple(range(20)), tuple(range(20, 40))}


def test_follow_of_rows_in_no_file(spark):
    docs = frame(spark, odd_documents())
    assert packing.pack(docs, follow=True).count() == packing.pack(docs).count()
    assert packing.pack(frame(spark, []), follow=True).count() == 0
