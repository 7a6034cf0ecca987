"""Identifier and frequency normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: they must equal those of the annotation files
FREQUENCIES = {
    "VR": "VERY_RARE", "VERYRARE": "VERY_RARE", "VERY_RARE": "VERY_RARE",
    "OC": "OCCASIONAL", "OCCASIONAL": "OCCASIONAL",
    "F": "FREQUENT", "FREQUENT": "FREQUENT",
    "VF": "VERY_FREQUENT", "VERYFREQUENT": "VERY_FREQUENT", "VERY_FREQUENT": "VERY_FREQUENT",
    "OB": "OBLIGATE", "OBLIGATE": "OBLIGATE",
    "EXCLUDED": "EXCLUDED", "0%": "EXCLUDED", "NONE": "EXCLUDED", "ABSENT": "EXCLUDED", "NOT": "EXCLUDED",
}
# fixed values: phrases looked for in this order
FREQUENCY_PHRASES = (
    ("excluded", "EXCLUDED"), ("obligate", "OBLIGATE"), ("very frequent", "VERY_FREQUENT"),
    ("frequent", "FREQUENT"), ("occasional", "OCCASIONAL"), ("very rare", "VERY_RARE"),
)


def normalize_term_id(x: Column) -> Column:
    """``HP:`` and seven digits, or null."""
    y = F.upper(F.translate(stripped(x), "_", ":"))
    return F.when(y.rlike(r"^HP:\d{7}$"), y)


def normalize_disease_id(x: Column) -> Column:
    """Prefixes in their display form; blank is null, unknown forms stay."""
    y = stripped(x)
    y = F.when(y.startswith("http"), F.regexp_extract(y, r"([^/]*)/*$", 1)).otherwise(y)
    rest = lambda pattern: F.regexp_replace(y, pattern, "")
    return (
        F.when(stripped(x) == "", None)
        .when(y.rlike("^(Orphanet|ORPHA|ORPHANET)_"), F.concat(F.lit("ORPHA:"), rest("^[A-Za-z]+_")))
        .when(y.rlike("^(MONDO|OMIM)_"), F.regexp_replace(y, "^([A-Z]+)_", "$1:"))
        .when(y.rlike("^(Orphanet|ORPHANET):"), F.concat(F.lit("ORPHA:"), rest("^[A-Za-z]+:")))
        .when(y.startswith("MIM:"), F.concat(F.lit("OMIM:"), rest("^MIM:")))
        .when(y.rlike(r"^\d+$"), F.concat(F.lit("ORPHA:"), y))
        .otherwise(y)
    )


def normalize_frequency(x: Column) -> Column:
    y = stripped(x)
    table = F.create_map(*[F.lit(v) for kv in FREQUENCIES.items() for v in kv])
    out = F.when(y == "", None).when(F.upper(y).isin(list(FREQUENCIES)), table[F.upper(y)])
    for phrase, name in FREQUENCY_PHRASES:
        out = out.when(F.lower(y).contains(phrase), name)
    return out.otherwise(y)


# fixed values: spellings of the prefixes in cross references
REFERENCES = {"ORPHA": "ORPHA|ORPHANET", "OMIM": "OMIM|MIM", "MONDO": "MONDO"}
# fixed values: readable names of profile types, and the words that give a type, looked for in this order
PROFILE_TYPES = {
    "specific_disease": "Specific disease", "disease_group": "Disease group", "category": "Category", "subtype": "Subtype",
    "clinical_subtype": "Clinical subtype", "etiological_subtype": "Etiological subtype", "histopathological_subtype": "Histopathological subtype",
}
TYPE_WORDS = (
    ("category", "category"), ("group", "disease_group"), ("clinical subtype", "clinical_subtype"), ("etiological subtype", "etiological_subtype"),
    ("aetiological subtype", "etiological_subtype"), ("histopathological subtype", "histopathological_subtype"), ("subtype", "subtype"),
    ("disorder", "specific_disease"), ("disease", "specific_disease"),
)
# fixed values: prefixes of values that name a disease in another source
LINKABLE = ("ORPHA:", "OMIM:", "MONDO:", "DECIPHER:", "DOID:", "MIM:", "Orphanet_", "MONDO_")


def stripped(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def normalize_xref(x: Column) -> Column:
    return F.replace(stripped(x), F.lit("Orphanet:"), F.lit("ORPHA:"))


def identifiers_in(refs: Column, prefix: str) -> Column:
    """All ``prefix`` numbers in an array of cross references, in order; a reference counts only as a whole."""
    pattern = rf"(?i)^(?:{REFERENCES[prefix]})\s*[:_]\s*(\d+)$"
    # the short spelling of OMIM takes no blanks
    if prefix == "OMIM":
        pattern = r"(?i)^(?:MIM:|OMIM\s*[:_]\s*)(\d+)$"
    found = F.transform(refs, lambda r: F.regexp_extract(normalize_xref(r), pattern, 1))
    return F.transform(F.filter(found, lambda r: r != ""), lambda r: F.concat(F.lit(prefix + ":"), r))


def first_orpha(refs: Column) -> Column:
    return F.get(identifiers_in(refs, "ORPHA"), F.lit(0))


def orpha_in_matches(matches: Column) -> Column:
    """The first exact match that ends in an Orphanet number or is a reference to one."""
    def number(m: Column) -> Column:
        tail = F.regexp_extract(stripped(m), r"Orphanet_(\d+)$", 1)
        return F.when(tail != "", F.concat(F.lit("ORPHA:"), tail)).otherwise(first_orpha(F.array(m)))

    return F.get(F.filter(F.transform(matches, number), lambda x: x.isNotNull()), F.lit(0))


def normalize_profile_type(x: Column) -> Column:
    """A known type by the words in the text; null for identifiers and anything else."""
    y = F.lower(stripped(x))
    out = F.when(y.rlike(r"^((orpha|orphanet|ordo)[:_])?\d+$"), None)
    for word, name in TYPE_WORDS:
        out = out.when(y.contains(word), name)
    return out


def profile_type_label(x: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in PROFILE_TYPES.items() for v in kv])
    return F.when(x != "", F.coalesce(table[x], F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))))


def is_linkable(key: Column, value: Column) -> Column:
    """Whether a source's value names the same disease elsewhere, and isn't a frequency code or a term."""
    named = F.lit(False)
    for prefix in LINKABLE:
        named = named | value.startswith(prefix)
    return F.coalesce(~key.endswith("_frequency_codes") & named, F.lit(False))


def is_negative(qualifier: Column, frequency: Column) -> Column:
    return F.coalesce(F.upper(stripped(qualifier)) == "NOT", F.lit(False)) | F.coalesce(normalize_frequency(frequency) == "EXCLUDED", F.lit(False))
