import duckdb
import pytest

from phenoweave.llm import licenses, queries


@pytest.fixture(scope="module")
def model(spark, sf):
    return licenses.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_notices_and_other_text(spark, model):
    rows = [
        (1, "Some prose here.\nReleased under the MIT License."),
        (2, "Licensed under the Apache License, Version 2.0.\nx"),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "The license of the driver was public and free, and the work of the version is under review."),
        (6, None), (7, ""), (8, "\n \n"),
        (9, "word " * 5000 + "Licensed under the Apache License, Version 2.0. " + "word " * 5000),
        (10, "Licensed under CC BY-SA 4.0.\nLicensed under CC BY-SA 4.0."),
        (None, "the of and"),
        (11, "mit und der die das mit nicht"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    out = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    assert {i: r.families for i, r in out.items() if r.families} == {1: ["mit"], 2: ["apache"], 3: ["gpl"], 4: ["cc-restricted"], 9: ["apache"], 10: ["cc"]}
    assert out[1].starts == [17] and out[10].n_notices == 2 and out[6].n_paragraphs == 0 and out[8].n_paragraphs == 0
    assert licenses.scan(docs.limit(0), model).count() == 0


def test_planted_notices_are_found_and_prose_is_left_alone(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    cues = {"Apache License": "apache", "MIT License": "mit", "General Public": "gpl", "CC BY-NC": "cc-restricted", "All rights reserved": "proprietary"}
    for d in docs.collect():
        want = sorted({f for cue, f in cues.items() if cue in d.text})
        assert out[d.doc_id].families == want, d.text


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert set(names) == set(got.columns)
    assert sorted((tuple(r) for r in got.select(names).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_row_once(spark, sf, name):
    table, key = ("pages", "page_id") if name.startswith("op8") else ("documents", "doc_id")
    ids = sorted(r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in queries.QUERIES[name](spark, sf).select(key).collect()) == ids
