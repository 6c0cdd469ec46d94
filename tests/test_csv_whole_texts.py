"""Whole texts through CSV: long fields, and CR and CRLF inside quotes."""

from martlet.suite.registry import QUERIES

TEXTS = ["x\r\ny", "\r", 'a\rb\n\r\n"q",\r', "", None, 'back\\slash\\"', "é中😀\n" * 3000, "w " * 20_000, "a,b\r\n" * 500]


def test_every_text_comes_back_whole(spark, tmp_path):
    rows = [(i, "en", "s", t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.note for r in QUERIES["src_csv_whole_texts"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else f'"s", {t}\n"en"; end' for i, t in enumerate(TEXTS)}
