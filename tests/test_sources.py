import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from phenoweave.operators import registry
from phenoweave.sources import artifacts, readers, sinks

OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://r" xmlns:owl="http://o" xmlns:rdfs="http://s" xmlns:obo="http://b/" xmlns:oboInOwl="http://i" xmlns:skos="http://k">
<owl:Class rdf:about="http://x/obo/HP_0000001"><rdfs:label xml:lang="en">All</rdfs:label></owl:Class>
<owl:Class rdf:about="http://x/obo/HP_0000002">
  <rdfs:subClassOf rdf:resource="http://x/obo/HP_0000001"/><rdfs:subClassOf rdf:resource="http://x/obo/UP_1"/>
  <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://x/p"/></owl:Restriction></rdfs:subClassOf>
  <rdfs:label>Tall</rdfs:label><oboInOwl:hasDbXref xml:lang="en"> UMLS:1 </oboInOwl:hasDbXref>
  <obo:IAO_0000115 xml:lang="en">Taller.</obo:IAO_0000115><rdfs:comment xml:lang="en">C</rdfs:comment>
</owl:Class>
<owl:Class rdf:about="http://x/ORDO/Orphanet_7"><rdfs:subClassOf rdf:resource="http://x/ORDO/Orphanet_9"/><rdfs:label>D</rdfs:label></owl:Class>
<owl:Class rdf:about="http://x/ORDO/Orphanet_9"/>
<owl:Class><rdfs:label>unnamed</rdfs:label></owl:Class>
</rdf:RDF>"""
DISORDERS = """<?xml version="1.0"?><JDBOR><L>
<Disorder id="1"><OrphaCode>58</OrphaCode><HPODisorderAssociationList count="2">
<HPODisorderAssociation id="1"><HPO id="1"><HPOId>HP:0000256</HPOId></HPO><HPOFrequency id="1"><Name lang="en">Very frequent (99-80%)</Name></HPOFrequency></HPODisorderAssociation>
<HPODisorderAssociation id="2"><HPO id="2"><HPOId>HP:0001249</HPOId></HPO><HPOFrequency id="2"><Name lang="en">Occasional (29-5%)</Name></HPOFrequency></HPODisorderAssociation>
</HPODisorderAssociationList></Disorder></L></JDBOR>"""


def rows(df):
    return [tuple(r) for r in df.collect()]


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_owl(spark, tmp_path):
    p = put(tmp_path, "o.owl", OWL)
    assert sorted(rows(readers.phenotype_terms(spark, p))) == [("HP:0000001", "All", []), ("HP:0000002", "Tall", ["HP:0000001"])]
    d = readers.owl_classes(spark, p, ("HP_",)).where("local_id = 'HP_0000002'").first()
    assert (d.description, d.xrefs) == ("Taller.", ["UMLS:1"])
    assert sorted(rows(readers.disease_edges(spark, p)), key=str) == [("ORPHA:7", "ORPHA:9"), ("ORPHA:9", None)]


def test_annotations(spark, tmp_path):
    p = put(tmp_path, "a.hpoa", "#v 1\n#d\ndatabase_id\tdisease_name\tqualifier\thpo_id\tfrequency\nOMIM:1\tA \"q\tNOT\tHP:0000001\t1/2\nOMIM:2\tB\t\tHP:0000002\t\nOMIM:3\tC\t\t\t\n")
    assert sorted(rows(readers.annotations_tsv(spark, p)), key=str) == [("OMIM:1", 'A "q', "NOT", "HP:0000001", "1/2", "HPOA"), ("OMIM:2", "B", None, "HP:0000002", None, "HPOA")]
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as f:
        f.write("subject\tsubject_label\tobject\tnegated\nMONDO:1\tM\tHP:0000001\tFalse\nMONDO:1\tM\tHP:0000001\tFalse\nX:1\tN\tHP:0000001\t\nOMIM:1\tO\tGO:1\t\n")
    assert rows(readers.associations_tsv(spark, str(tmp_path / "m.tsv.gz"))) == [("MONDO:1", "M", None, "HP:0000001", None, "MONARCH")]
    d = readers.disorder_xml(spark, put(tmp_path, "d.xml", DISORDERS))
    assert sorted(rows(d)) == [("ORPHA:58", "HP:0000256", "VERY_FREQUENT", "ORPHADATA"), ("ORPHA:58", "HP:0001249", "OCCASIONAL", "ORPHADATA")]


def test_cases(spark, tmp_path):
    p = put(tmp_path, "MME.json", json.dumps([[["HP:1", "HP:2"], ["OMIM:1"]], [[], ["OMIM:2"]]], indent=1))
    assert rows(readers.term_cases(spark, p)) == [("MME", 0, ["HP:1", "HP:2"], ["OMIM:1"]), ("MME", 1, [], ["OMIM:2"])]
    assert rows(readers.term_cases(spark, p, strict=True)) == rows(readers.term_cases(spark, p))
    with pytest.raises(Exception, match="not two lists"):
        readers.term_cases(spark, put(tmp_path, "bad.json", '[[["HP:1"]]]'), strict=True).collect()
    p = put(tmp_path, "t.json", json.dumps([{"id": "c", "text": "tall", "disease_codes": ["12", "12"]}, {"raw_text": " "}]))
    assert rows(readers.raw_text_cases(spark, p)) == [("t", 0, "c", "tall", ["ORPHA:12"])]
    p = put(tmp_path, "u.json", json.dumps({"5": "short", "OMIM:6": "x"}))
    assert rows(readers.raw_text_cases(spark, p)) == [("u", 0, "5", "short", ["ORPHA:5"]), ("u", 1, "OMIM:6", "x", ["OMIM:6"])]
    p = put(tmp_path, "n.json", json.dumps([{"hpo_terms": ["b ", "a", "b"], "disease_codes": ["D"]}]))
    assert rows(readers.signed_cases(spark, p)) == [("n", 0, ["a", "b"], [], ["D"])]


def test_packets(spark, tmp_path):
    feature = lambda i, out=False: {"type": {"id": i}, "excluded": out}
    p = put(tmp_path, "p.json", json.dumps({"id": "p", "phenotypicFeatures": [feature("HP:2"), feature("HP:1"), feature("HP:3", True), feature("X:1")], "diseases": [{"term": {"id": "OMIM:1"}}]}))
    m = spark.createDataFrame([("OMIM:1", "ORPHA:1")], "id string, target string")
    assert rows(readers.phenopackets(spark, p, m)) == [("p", ["HP:1", "HP:2"], ["HP:3"], ["OMIM:1", "ORPHA:1"])]
    p = put(tmp_path, "g.jsonl", '{"id":"a","hpo":["HP:1"],"orpha":["3","4"],"omim":"5"}\n{"id":"b","hpo":["HP:1"],"orpha":"3"}\n{"id":"c","hpo":[]}\n')
    assert rows(readers.gene_cases(spark, p)) == [("a", ["HP:1"], ["ORPHA:3", "ORPHA:4", "OMIM:5"]), ("b", ["HP:1"], ["ORPHA:3"])]


def test_results(spark, tmp_path):
    (tmp_path / "c").mkdir()
    put(tmp_path, "c/case_7.json", json.dumps({"method_elapsed": {"m": 0.5}, "results": {"m": [{"disease_id": "D", "rank": 1, "score": 0.25}]}}))
    assert rows(readers.case_cache(spark, str(tmp_path / "c"))) == [(7, "m", "D", 1, 0.25, 0.5)]
    p = put(tmp_path, "l.tsv", "! a\nrank\tdiseaseCurie\tposttestprob\n1,024\tOMIM:1\t3%\n")
    assert rows(readers.ranked_tsv(spark, p)) == [(1024, "OMIM:1", "3%")]
    p = put(tmp_path, "f.tsv", "#h\n0.1\t1\tOMIM:1\n\n0.2\t1\tOMIM:2\n")
    assert rows(readers.ordered_tsv(spark, p)) == [("f.tsv", 1, "OMIM:1"), ("f.tsv", 2, "OMIM:2")]


def test_sinks(spark, tmp_path):
    one = spark.createDataFrame([("a", "m", 0, 1.0), ("a", "m", 1, 2.0), ("a", "n", 0, 3.0)], "dataset string, method string, case_index int, score double")
    two = spark.createDataFrame([("a", "m", 1, 9.0)], one.schema)
    at = str(tmp_path / "cache")
    sinks.upsert_cases(one, at)
    sinks.upsert_cases(two, at)
    assert sorted(rows(spark.read.schema(one.schema).parquet(at).select(*one.columns))) == [("a", "m", 0, 1.0), ("a", "m", 1, 9.0), ("a", "n", 0, 3.0)]
    for ts in ("2020", "2021"):
        sinks.append_run(two, str(tmp_path / "runs"), "p1", ts)
    assert rows(sinks.list_runs(spark, str(tmp_path / "runs"), "p")) == [("p1", "2021", 1), ("p1", "2020", 1)]
    sinks.write_summary(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "s_summary.tsv"))
    assert rows(spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "s_summary.tsv"))) == [("a", "None")]
    sinks.write_rankings(one.withColumnRenamed("score", "s"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3
    base = spark.createDataFrame([("a", 0, ["t"], ["d"])], "dataset string, case_index int, hpo_terms array<string>, ground_truth array<string>")
    assert sinks.check_aligned(base, base).count() == 1
    other = spark.createDataFrame([("a", 0, ["u"], ["d"])], base.schema)
    with pytest.raises(Exception, match="differs"):
        sinks.check_aligned(other, base).collect()


def test_axioms(spark, tmp_path):
    body = "".join(
        f'<EquivalentClasses><Class IRI="{iri}"/>{rest}</EquivalentClasses>'
        for iri, rest in (
            ("#Orpha:58_HP:256_Freq:vf", '<ObjectIntersectionOf><Class IRI="#x"/><ObjectSomeValuesFrom><ObjectProperty IRI="#has_frequency"/><Class IRI="#VeryRare"/></ObjectSomeValuesFrom></ObjectIntersectionOf>'),
            ("#orpha:7_HP:0000001_Freq:oc", ""), ("#orpha:7_HP:0000001_Freq:OC", ""), ("#other", ""),
        )
    )
    p = put(tmp_path, "h.owx", f"<Ontology>{body}</Ontology>")
    got = sorted(rows(artifacts.axiom_annotations(spark, p).select("database_id", "hpo_id", "frequency_code")))
    assert got == [("ORPHA:58", "HP:0000256", "VeryRare"), ("ORPHA:7", "HP:0000001", "OC")]


def test_tables_of_other_tools(spark, tmp_path):
    assert artifacts.delimited(spark, put(tmp_path, "a.txt", "x\ty\n1\t2,3\n")).first().asDict() == {"x": "1", "y": "2,3"}
    assert artifacts.delimited(spark, put(tmp_path, "b.txt", "x,y\n1,2\n")).first().asDict() == {"x": "1", "y": "2"}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>rank</t></si><si><t>A</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row/><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>3</v></c></row></sheetData></worksheet>')
    assert [tuple(x) for x in artifacts.spreadsheets(spark, str(tmp_path / "c.xlsx")).collect()] == [("c.xlsx", 0, {"name": "A", "rank": "3"})]
    m = put(tmp_path, "MME.json", json.dumps({"method_metrics": {"set": {"recall_1": 0.5, "recall_10": 0.7, "mrr": 0.6}}, "method_avg_seconds": {"set": 1.5}}))
    assert rows(artifacts.metric_json(spark, m)) == [("MME", "set", 0.5, 0.7, 0.6, 1.5)]
    assert artifacts.datasets(spark, str(tmp_path), ["mme", "none"])[1] == ["none"]
    (tmp_path / "tool_benchmarks").mkdir()
    put(tmp_path / "tool_benchmarks", "MME_summary.tsv", "x")
    assert artifacts.benchmarks(spark, str(tmp_path)) == {"tool": ["MME"]}


def test_context_reports_and_vectors(spark, tmp_path):
    edge = spark.createDataFrame([("B", "A")], "child string, parent string")
    context = registry.Context(spark.createDataFrame([(1,)], "disease_id long"), spark.createDataFrame([(1, "B")], "disease_id long, term string"), edge)
    artifacts.write_context(context, str(tmp_path / "art"))
    again = artifacts.load_context(spark, str(tmp_path / "art"))
    assert again.profile_term.count() == 1 and again.text is None and again.ancestors.count() == 3
    with pytest.raises(ValueError):
        artifacts.load_context(spark, str(tmp_path / "none"))
    metrics = spark.createDataFrame([("b", 0.1, 0.5, 0.2), ("a", 0.2, 0.9, 0.4)], "method string, recall_1 double, recall_10 double, mrr double")
    assert artifacts.text_report(metrics).splitlines()[1].startswith("a ") and "&lt;x&gt;" in artifacts.html_report({"<x>": metrics})
    artifacts.write_text(spark, "hello é", str(tmp_path / "t.txt"))
    assert (tmp_path / "t.txt").read_text() == "hello é"
    texts, vectors = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string"), spark.createDataFrame([(1, [1.0])], "id long, vector array<double>")
    assert artifacts.read_vectors(spark, texts, str(tmp_path / "v")) is None
    artifacts.write_vectors(vectors, texts, str(tmp_path / "v"))
    assert artifacts.read_vectors(spark, texts.repartition(2), str(tmp_path / "v")).count() == 1
    assert artifacts.read_vectors(spark, texts.limit(1), str(tmp_path / "v")) is None
    packet = json.loads(artifacts.phenopacket("p", ["T"], {"T": "tall"}, ["m"], [{"disease_id": 1, "score": 0.5}] * 9, "2020"))
    assert packet["phenotypicFeatures"][0]["type"]["label"] == "tall" and len(packet["metaData"]["ranking"]["top_results"]) == 5
    patients = spark.createDataFrame([("a", None, ["T"]), ("b", "tall man", [])], "patient_id string, raw_text string, hpo_terms array<string>")
    found = artifacts.with_extraction(patients, lambda t, k: t.withColumn("term", F.lit("X")))
    assert sorted(rows(found)) == [("a", "T"), ("b", "X")]
    with pytest.raises(Exception, match="neither"):
        artifacts.with_extraction(spark.createDataFrame([("c", " ", [])], "patient_id string, raw_text string, hpo_terms array<string>"), lambda t, k: t.withColumn("term", F.lit("X"))).collect()
    assert rows(artifacts.unknown_terms(spark.createDataFrame([("a", "T"), ("a", "U")], "p string, term string"), spark.createDataFrame([("T",)], "term string"))) == [("U", "a")]
