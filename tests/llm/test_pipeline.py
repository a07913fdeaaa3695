"""The pipeline's stages, each on its predecessor's output."""


import corpus_pipeline as P
from burstlens.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _frame(spark):
    good = "The river of the north and the hill to the south are in the map that the office keeps for visitors"
    rows = [(1, good + "\nsecret = abcdefgh1234\nA second line of the first text, with its own words"),
            (2, good + "\nAnother line of the second document that is not found in the others at all"),
            (3, "###" * 40), (4, None), (5, ""), (6, "ha ha ha ha ha " * 30),
            (7, "A long and quite different text is in here, of the kind that has a message for the reader to find")]
    rows += [(7, rows[-1][1]), (8, rows[-1][1]), (None, "This text of the table has no number but is in it for the sake of the test and to be kept")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_chain_and_decide(spark):
    docs = _frame(spark)
    first = P.quality_rules(spark, docs, "")
    assert sorted(r["doc_id"] or 0 for r in first.collect()) == [0, 1, 2, 7, 7, 8]
    second = P.line_dedup(spark, first, "")
    kept = {r["doc_id"]: r for r in second.collect()}
    assert sorted(k or 0 for k in kept) == [0, 1, 2, 7] and kept[2]["text"].startswith("Another line")
    assert kept[2]["n_chars"] == len(kept[2]["text"]) and kept[2]["source"] == "s"
    third = P.simhash_dedup(spark, second, "")
    assert sorted(r["doc_id"] or 0 for r in third.collect()) == [0, 1, 2, 7]  # the repeated row once
    fourth = P.secret_scan(spark, third, "")
    text = {r["doc_id"]: r["text"] for r in fourth.collect()}
    assert "\n[assign]\n" in text[1] and text[7] == kept[7]["text"]
    for step in (first, second, third, fourth):
        assert step.columns == COLUMNS
    packed = P.packing_plan(spark, fourth, "").collect()
    assert sorted(r["doc_id"] or 0 for r in packed) == [0, 1, 2, 7]


def test_empty_table_passes_all_stages(spark):
    docs = _frame(spark).limit(0)
    for _, step in P.STAGES:
        docs = step(spark, docs, "")
    assert docs.count() == 0


def test_clean_documents_pass_quality(spark):
    docs = P.documents(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    judged = quality.quality(docs).filter("not base_failed").join(labels, "doc_id")
    assert judged.filter("not kept").count() <= 0.01 * judged.count()
