from cases import PASSAGE, frame, letters

import corpus_pipeline


def test_long_passages_of_one_or_two_lines_go(spark):
    half = [" ".join(letters(i, k) for k in range(30)) for i in range(2)]
    texts = {
        1: f"start\n{PASSAGE}\nend", 2: f"other\n{PASSAGE}", 3: PASSAGE, 4: PASSAGE + " more",
        5: "\n".join(half), 6: "head\n" + "\n".join(half), 7: f"{half[0]}\nbetween\n{half[1]}",
        8: f"{letters(9)}\n{'alpha ' * 51}\nmiddle\n alpha {'alpha  ' * 50}", 9: "beta " * 50, 10: "beta " * 50,
    }
    rows = [(i, t, "en", "a", len(t), "", "", "") for i, t in texts.items()] + [(1, texts[1], "en", "a", 1, "", "", "")]
    got = {(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, frame(spark, rows), "").collect()}
    want = texts | {2: "other", 3: "", 6: "head", 8: f"{letters(9)}\n{'alpha ' * 51}\nmiddle"}
    assert got == set(want.items())
