import pytest
from pyspark.sql import functions as F

from phenoweave.operators import intake, ontology


def test_patients(spark):
    ids = spark.createDataFrame([(1, "HP:0000002, hp_0000003,xx"), (2, "")], "patient_id long, ids string")
    labels = spark.createDataFrame([("HP:0000002", "tall", 1), ("HP:0000003", "thin", 2)], "term string, label string, ord int")
    assert sorted(tuple(r) for r in intake.from_ids(ids).collect()) == [(1, "HP:0000002"), (1, "HP:0000003")]
    assert intake.from_ids(ids, labels.limit(1)).count() == 1
    texts = spark.createDataFrame([(7, "A tall man"), (8, "nothing")], "patient_id long, text string")
    assert [tuple(r) for r in intake.from_texts(texts.where("patient_id = 7"), labels).collect()] == [(7, "HP:0000002")]
    with pytest.raises(Exception, match="no term in the text of 8"):
        intake.from_texts(texts, labels).collect()
    up = ontology.closure(spark.createDataFrame([("HP:0000002", "HP:0000001")], "child string, parent string"))
    p = intake.profiles(intake.from_ids(ids), up)
    assert p.first().propagated_hpo_terms == ["HP:0000001", "HP:0000002", "HP:0000003"]
    assert intake.active_terms(p, True).count() == 3 and intake.active_terms(p, False).count() == 2


def test_results(spark):
    rows = spark.createDataFrame([(1, "b", 1, 5, 0.5), (1, "a", 1, 6, 0.9), (1, "a", 2, 7, 0.1)], "patient_id long, method string, rank int, disease_id long, score double")
    assert [r.disease_id for r in intake.flatten(rows).orderBy("place").collect()] == [6, 5, 7]
    m = intake.by_method(rows).first().results
    assert [x.disease_id for x in m["a"]] == [6, 7] and [x.disease_id for x in m["b"]] == [5]
    df = spark.createDataFrame([("", "x", None), (None, " ", "y"), ("d", "x", "y")], "disease_id string, canonical_disease_id string, ordo_id string")
    assert [r[0] for r in df.select(intake.result_id(df)).collect()] == ["x", "y", "d"]
    assert spark.range(1).select(intake.case_id(F.lit(7))).first()[0] == "eval_case_0007"
