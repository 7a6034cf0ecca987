import json

from pyspark.sql import functions as F

from phenoweave.functions import responses


def test_confidence_and_asymmetry(spark):
    d = spark.createDataFrame([(" Strong", 0.9, 0.1), ("weak", 0.1, 0.9), ("sure", 0.5, 0.4), (None, 0.5, 0.5)], "w string, a double, b double")
    got = [tuple(r) for r in d.select(responses.confidence_score(F.col("w")), responses.asymmetry(F.col("a"), F.col("b"))).collect()]
    assert got == [(0.9, "patient_better_covered"), (0.3, "disease_better_covered"), (0.5, "symmetric"), (0.5, "symmetric")]


def test_phenotypes(spark):
    fenced = "Here:\n```json\n" + json.dumps({"phenotypes": ["tall", 3, "short {x}"]}, indent=1) + "\n```"
    many = json.dumps({"phenotypes": [str(i) for i in range(30)]})
    d = spark.createDataFrame([(x,) for x in (fenced, many, '{"a": 1}', "none", '{"phenotypes": "x"}', "", None)], "t string")
    got = [r[0] for r in d.select(responses.phenotypes_in(F.col("t"))).collect()]
    assert got == [["tall", "short {x}"], [str(i) for i in range(20)], [], [], [], [], []]
