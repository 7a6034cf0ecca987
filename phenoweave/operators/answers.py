"""Prompts for language models, and tables from what they answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import stripped
from ..functions.responses import confidence_score
from .extraction import containing

MOST_DESCRIPTION, MOST_LABELS = 400, 20
# fixed values: the record that a model is asked for, and what is read of it
RECORD = r"(?i)DISEASE:\s*(.+?)\s*\|\s*ORDO:\s*([\w:]+)\s*\|\s*MATCH:\s*(.+?)\s*\|\s*\w+:\s*([\w\s]+?)(?=DISEASE:|$)"
# fixed values: headings of the parts of an explanation
PARTS = (("VERDICT REASON:", "verdict_reason"), ("VERDICT:", "verdict"), ("CLINICAL REASONING:", "reasoning"))
NO_ANSWER = "No explanation generated."
LINES = r"[\r\n\x0b\x0c\x1c\x1d\x1e\u0085  ]+"


def clean_answer(text: Column) -> Column:
    """One line, with colons in identifiers, without the prompt's own marks."""
    y = F.regexp_replace(F.regexp_replace(text, r"ORPHA(\d+)", "ORPHA:$1"), r"OMIM(\d+)", "OMIM:$1")
    y = F.regexp_replace(F.regexp_replace(y, r"\[SOLUTION\]", ""), r"(?s)\[INST\].*?\[/INST\]", "")
    lines = F.transform(F.split(y, LINES), stripped)
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def records(answers: DataFrame, key: str) -> DataFrame:
    """``key, ord, name, id, matched, confidence`` of the records in ``answers (key, text)``."""
    line = answers.select(key, clean_answer(F.col("text")).alias("t"))
    groups = F.arrays_zip(*[F.regexp_extract_all("t", F.lit(RECORD), F.lit(i)).alias(n) for i, n in enumerate(("name", "id", "matched", "confidence"), 1)])
    rows = line.select(key, F.posexplode(groups).alias("ord", "g"))
    return rows.select(key, "ord", *[stripped(F.col(f"g.{n}")).alias(n) for n in ("name", "id", "matched")], F.lower(stripped(F.col("g.confidence"))).alias("confidence"))


def find_diseases(named: DataFrame, profiles: DataFrame) -> DataFrame:
    """``named (id, name, ...)`` with matched_id, label, validated.

    A profile (``disease_id, label, ord``) matches by its id, then by its id
    without colons, then as the first whose label contains the name or lies in it,
    in any case.  Others keep their own id and name.
    """
    exact = profiles.select(F.col("disease_id").alias("id"), F.col("disease_id").alias("by_id"))
    bare = profiles.groupBy(F.replace("disease_id", F.lit(":"), F.lit("")).alias("bare")).agg(F.min(F.struct("ord", "disease_id"))["disease_id"].alias("by_bare"))
    low = profiles.select("disease_id", "ord", F.lower(F.coalesce("label", F.lit(""))).alias("name_"))
    blank = low.where("name_ = ''").agg(F.min(F.struct("ord", "disease_id")).alias("x"))  # lies in every name
    asked = named.withColumn("low_", F.lower("name")).withColumn("bare", F.replace("id", F.lit(":"), F.lit("")))
    pairs = containing(asked.select(F.col("low_").alias("phrase")), low.select(F.col("name_").alias("name")))
    near = pairs.join(low.withColumnRenamed("name_", "name"), "name").groupBy(F.col("phrase").alias("low_")).agg(F.min(F.struct("ord", "disease_id")).alias("n"))
    out = asked.join(exact, "id", "left").join(bare, "bare", "left").join(near, "low_", "left").crossJoin(F.broadcast(blank))  # one row
    by_label = F.least("n", "x")["disease_id"]  # least passes over nulls
    out = out.withColumn("matched_id", F.coalesce("by_id", "by_bare", by_label)).drop("bare", "by_id", "by_bare", "n", "x", "low_")
    out = out.join(profiles.select(F.col("disease_id").alias("matched_id"), F.col("label").alias("label_")), "matched_id", "left")
    return out.withColumn("validated", F.col("matched_id").isNotNull()).withColumn("label", F.coalesce("label_", "name")).withColumn("matched_id", F.coalesce("matched_id", "id")).drop("label_")


def ranked_answers(answers: DataFrame, key: str, profiles: DataFrame, k: int = 10, by_confidence: bool = True) -> DataFrame:
    """The diseases that each answer names, each once, at its first place; the first ``k`` of them.

    Ranked by the score of the confidence word (ties in the answer's order), or in
    the answer's order.
    """
    found = find_diseases(records(answers, key), profiles)
    first = Window.partitionBy(key, "matched_id").orderBy("ord")
    once = found.withColumn("r_", F.row_number().over(first)).where("r_ = 1").drop("r_").withColumn("score", confidence_score(F.col("confidence")))
    if not by_confidence:
        listed = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
        return once.withColumn("rank", listed).where(F.col("rank") <= k)
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= k)


def explanation(text: Column) -> Column:
    """reasoning, verdict, verdict_reason and text of an explanation, by its headings.

    Lines after a heading go on with its part until the next part is begun; the
    reason of the verdict is one line.  Without a verdict the text is the first
    three sentences.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINES), stripped), lambda x: x != "")
    start = F.struct(*[F.lit("").alias(n) for n in ("reasoning", "verdict", "verdict_reason", "part")])

    def step(s: Column, line: Column) -> Column:
        up, rest = F.upper(line), stripped(F.regexp_replace(line, "^[^:]*:", ""))
        make = lambda **new: F.struct(*[new.get(n, s[n]).alias(n) for n in ("reasoning", "verdict", "verdict_reason", "part")])
        out = F.when(up.startswith(PARTS[0][0]), make(verdict_reason=rest, part=F.lit("verdict_reason")))
        out = out.when(up.startswith(PARTS[1][0]), make(verdict=rest, part=F.lit("verdict")))
        out = out.when(up.startswith(PARTS[2][0]), make(reasoning=F.when(rest != "", rest).otherwise(s["reasoning"]), part=F.lit("reasoning")))
        out = out.when((s["part"] == "reasoning") & (s["verdict"] == ""), make(reasoning=F.concat(s["reasoning"], F.lit(" "), line)))
        more = (s["part"] == "verdict") & (s["verdict_reason"] == "") & ~up.startswith("VERDICT")
        return out.when(more, make(verdict=F.concat(s["verdict"], F.lit(" "), line))).otherwise(s)

    def finish(s: Column) -> Column:
        parts = {n: stripped(s[n]) for n in ("reasoning", "verdict", "verdict_reason")}
        some = lambda c: F.when(c != "", c)
        judged = F.concat_ws(" | ", some(parts["reasoning"]), F.concat(F.lit("Verdict: "), parts["verdict"]), some(parts["verdict_reason"]))
        sentences = F.filter(F.transform(F.slice(F.split(stripped(F.coalesce(text, F.lit(""))), r"\."), 1, 3), stripped), lambda x: x != "")
        short = F.array_join(sentences, ". ")
        plain = F.when((short != "") & ~short.endswith("."), F.concat(short, F.lit("."))).otherwise(short)
        whole = F.when(F.coalesce(text, F.lit("")) == "", NO_ANSWER).when(s["verdict"] != "", judged).otherwise(plain)
        return F.struct(*[c.alias(n) for n, c in parts.items()], whole.alias("text"))

    return F.aggregate(lines, start, step, finish)


def patient_context(raw_text: Column, labels: Column) -> Column:
    """What a model is told of a patient: the description, then the labels."""
    text = F.nullif(stripped(F.coalesce(raw_text, F.lit(""))), F.lit(""))
    shown = F.when(F.size(labels) > 0, F.concat(F.lit("Patient phenotypes: "), F.array_join(labels, ", ")))
    return F.concat_ws("\n", F.concat(F.lit("Clinical description: "), text), shown)


def disease_preview(label: Column, description: Column, labels: Column) -> Column:
    """What a model is told of a disease: label, start of the description, first labels."""
    text = F.nullif(stripped(F.coalesce(description, F.lit(""))), F.lit(""))
    shown = F.when(F.size(labels) > 0, F.concat(F.lit("Phenotypes: "), F.array_join(F.slice(labels, 1, MOST_LABELS), ", ")))
    return F.concat_ws("\n", F.concat(F.lit("Disease: "), label), F.concat(F.lit("Description: "), F.substring(text, 1, MOST_DESCRIPTION)), shown)


def retrieval_prompt(raw_text: Column, labels: Column, k: int) -> Column:
    """Asks for ``k`` diseases, one record on a line, in the form that :func:`records` reads."""
    form = "DISEASE: <name> | ORDO: ORPHA:<number> | MATCH: <phenotypes> | CONFIDENCE: <high/medium/low>"
    task = f"Name exactly {k} different rare diseases that fit this patient best, no disease twice.\nWrite one line for each, in this form:\n{form}"
    return F.concat(F.lit("[INST] "), F.concat_ws("\n", patient_context(raw_text, labels), F.lit(task)), F.lit(" [/INST]"))


def explanation_prompt(context: Column, preview: Column, shared: Column, only_patient: Column) -> Column:
    """Asks for a judgement of one pair, with the headings that :func:`explanation` reads."""
    listed = lambda name, c: F.concat(F.lit(f"{name}: "), F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("none"))
    task = "Judge how well the disease explains the patient. Answer under these headings:\nCLINICAL REASONING:\nVERDICT: STRONG MATCH, POSSIBLE MATCH, WEAK MATCH or UNLIKELY\nVERDICT REASON:"
    return F.concat(F.lit("[INST] "), F.concat_ws("\n", context, preview, listed("Shared phenotypes", shared), listed("Patient only", only_patient), F.lit(task)), F.lit(" [/INST]"))


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)
