"""Keys and marks of whole texts, beyond the first 80 and 400 characters."""

from noticeweave.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if r.text is not None}
    marked = {r.doc_id: r.html for r in QUERIES["highlights_whole"](spark, FOLDER).collect()}
    keys = {r.doc_id: r.title_key for r in QUERIES["title_keys_whole"](spark, FOLDER).collect()}
    assert any(t.lower().find("the", 400) > 0 for t in texts.values())
    for i, t in texts.items():
        assert marked[i].count("<mark>") == t.lower().count("the")
        assert sum(c.isascii() and c.isalnum() for c in keys[i]) == sum(c.isascii() and c.isalnum() for c in t.replace("ß", "ss"))
