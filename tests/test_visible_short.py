"""Outputs of few or no blanks are found in documents like long ones."""

import pytest

from tracelake.operators import documents


@pytest.mark.parametrize("limit", [documents.MAX_SHORT_CHARS, 0])
def test_visible_full_finds_short_outputs(spark, monkeypatch, limit):
    monkeypatch.setattr(documents, "MAX_SHORT_CHARS", limit)
    texts = ["a b\nc d e f g h i j\nk", "xfoox\nb", "\u5b57\u5b57\u8a9e\n\u6587\u7ae0", None, ""]
    items = ["foo", "b\nc d", "\u8a9e\n\u6587", "c d e f g h i j", "e f g h i", "absent", "b", "", None]
    source = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, d, t[: t.index(x)].count("\n"), x.count("\n") + 1) for i, x in enumerate(items) for d, t in enumerate(texts) if x and t and x in t}
    rows = [tuple(x) for x in documents.visible_full(source, out).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
