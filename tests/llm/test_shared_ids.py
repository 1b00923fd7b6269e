"""Rows that share a doc_id but not their text, through the pipeline's decontamination."""

from ledgerlens.llm import decontaminate

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_clean_row_stays_beside_a_contaminated_one_of_the_same_id(spark):
    leaked = " ".join(f"w{k}" for k in range(20))
    rows = [(1, f"so {leaked} it is", "en", "s", 1), (1, "a clean text of the same id", "en", "s", 1), (2, None, "en", "s", 1), (None, leaked, "en", "s", 1), (None, "clean", "en", "s", 1)]
    items = spark.createDataFrame([(7, leaked)], "item_id long, text string")
    out = decontaminate.decontaminate(spark.createDataFrame(rows, DOCS), items)
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == [("1", "a clean text of the same id"), ("2", ""), ("None", "clean")]
