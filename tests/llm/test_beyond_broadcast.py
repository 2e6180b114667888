"""What is too much to broadcast takes another way, with the same result; very long texts are one row's work."""

import pytest
from test_operators import as_rows

from quernal.llm import decontam, licences, linedup, mixing, neardup

ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def items(spark, corpus):
    return spark.createDataFrame([(i, r[1]) for i, r in enumerate(corpus[:30:3])] + [(90, "one two three four"), (91, None)], ITEMS)


@pytest.mark.parametrize(
    ("module", "names", "run"),
    [
        (linedup, ["BROADCAST_ROWS"], lambda docs, items: linedup.strip(docs)),
        (neardup, ["BROADCAST_IDS"], lambda docs, items: neardup.near_duplicates(docs)),
        (mixing, ["BROADCAST_SOURCES"], lambda docs, items: mixing.mix(docs)),
        (decontam, ["BROADCAST_SEEDS", "BROADCAST_IDS"], lambda docs, items: decontam.keep(docs, items)),
    ],
    ids=["linedup", "neardup", "mixing", "decontam"],
)
def test_results_beyond_a_broadcast(docs, items, monkeypatch, module, names, run):
    want = as_rows(run(docs, items))
    for name in names:
        monkeypatch.setattr(module, name, 0)
    assert as_rows(run(docs, items)) == want and want


def test_very_long_texts(spark, items):
    long = " ".join(f"w{i % 50_000}" for i in range(150_000)) + "\nlast line of it here"
    rows = [(1, long, "en", "s"), (2, long, "en", "s"), (3, "password = abcdef123 " + "x" * 300_000, "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.kept for r in neardup.near_duplicates(docs).where("doc_id = 2").select("kept").collect()} == {False}
    assert decontam.keep(docs, items).count() == 3 and licences.licences(docs).count() == 3
    assert mixing.mix(docs).count() >= 3
