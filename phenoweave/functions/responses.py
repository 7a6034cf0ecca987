"""Model answers and score gaps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import stripped

# fixed values: scores of the confidence words, and of any other word
CONFIDENCE = {"strong": 0.9, "possible": 0.6, "weak": 0.3, "unlikely": 0.1}
OTHER_CONFIDENCE = 0.5
MOST_PHENOTYPES = 20
SYMMETRIC_WITHIN = 0.15


def confidence_score(word: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in CONFIDENCE.items() for v in kv])
    return F.coalesce(table[F.lower(stripped(word))], F.lit(OTHER_CONFIDENCE))


def phenotypes_in(answer: Column) -> Column:
    """The first strings of the ``phenotypes`` list in the answer's JSON object; empty where there is none.

    What stands around the object, such as code fences, is ignored.  Items that
    aren't strings are dropped after the cut.
    """
    found = F.get_json_object(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "$.phenotypes")
    items = F.from_json(found, "array<variant>")
    strings = F.filter(F.slice(items, 1, MOST_PHENOTYPES), lambda v: F.schema_of_variant(v) == "STRING")
    texts = F.transform(strings, lambda v: F.variant_get(v, "$", "string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def asymmetry(patient_to_disease: Column, disease_to_patient: Column) -> Column:
    """Which side of a two-way average is covered better."""
    gap = patient_to_disease - disease_to_patient
    return F.when(F.abs(gap) < SYMMETRIC_WITHIN, "symmetric").when(gap > 0, "patient_better_covered").otherwise("disease_better_covered")
