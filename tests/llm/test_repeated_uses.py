from collections import Counter

from cases import frame

from rankfield.llm import packing


def test_uses_of_a_document_fall_into_different_batches(spark):
    rows = [(i, f"one two three {i}", "en", "a", 1, "", "", "") for i in range(300)]
    packed = packing.pack(frame(spark, rows + rows), batch_tokens=40).collect()
    assert Counter(r.doc_id for r in packed) == Counter({i: 2 for i in range(300)})
    assert max(Counter((r.bucket, r.batch) for r in packed).values()) == 10
    together = sum(n > 1 for n in Counter((r.doc_id, r.bucket, r.batch) for r in packed).values())
    assert together < 30, "by chance 1 in 60 documents has both uses in one batch"
