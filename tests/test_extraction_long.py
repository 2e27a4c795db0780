"""Sections longer than a call holds."""

from tripleloom.operators import extraction


def test_long_sections_are_read_to_their_end(spark):
    body = "".join(f"{i:09} " for i in range(1001))
    text = "# Head\n" + body + "\n## Next\n" + "word " * 20
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    seen = extraction.call(extraction.sections(df), lambda p, s: p).orderBy("section_no").collect()
    assert [r["section_no"] for r in seen] == list(range(4)) and all(len(r["reply"]) <= extraction.CALL_CHARS for r in seen)
    assert "".join(r["reply"] for r in seen[:3]) == ("# Head\n" + body).strip()
    assert extraction.sections(df, max_sections=1).count() == 3
