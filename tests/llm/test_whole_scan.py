from phenoweave.llm import licenses


def test_notices_in_the_sample_are_still_found(spark):
    prose = "the quick harbour keeps its lanterns lit through every winter evening {0}"
    rows = [(i, prose.format(i)) for i in range(60)] + [(100 + i, "Released under CC0 1.0.") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: list(r.families) for r in licenses.annotate(docs).collect()}
    assert all(found[100 + i] == ["cc"] for i in range(3))
    assert not any(found[i] for i in range(60))
