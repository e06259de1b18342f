"""A query on rows that the driver's tables do not have."""

import __spark_entry__ as entry


def test_text_of_documents_without_a_first_line(spark, tmp_path):
    rows = [(1, " \nx", "en", "s"), (2, "", "en", "s"), (3, " y \nz", "en", "s"), (4, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["node_text"] for r in entry.queries()["node_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "METHOD s in a\\en/s.java", 2: "METHOD s in a\\en/s.java", 3: "METHOD s in en/s: y", 4: "METHOD s in en/s: s"}
