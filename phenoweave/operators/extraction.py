"""Terms found in texts: by dictionary, by phrases of other extractors, and their merging.

Found terms are rows ``<key>, term, matched_text, method, confidence, start, end, negated``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_negated, normalize_text

GRAM = 8  # characters by which phrases and labels that contain each other are joined
WORD = "[a-z0-9]+"
#: Least characters of the label, and of the phrase, for a match by containment.
RULES = {"ner": (10, 0), "gpt": (8, 8)}


def label_lookup(labels: DataFrame) -> DataFrame:
    """``name, term, ord`` of normalised labels from ``term, label, ord``.

    Of labels that are equal so, the last one gives the term and the first one the place.
    """
    named = labels.select(normalize_text(F.col("label")).alias("name"), "term", "ord").where("name <> ''")
    return named.groupBy("name").agg(F.max(F.struct("ord", "term"))["term"].alias("term"), F.min("ord").alias("ord"))


def dictionary(texts: DataFrame, key: str, lookup: DataFrame, skip_negated: bool = True) -> DataFrame:
    """Every place where a label stands as whole words, in texts ``key, text`` (one row for each key).

    Offsets count in the normalised text.  Runs of as many words as labels have are
    joined by the whole label, so labels that begin alike cost nothing; occurrences
    of one label don't overlap.  Labels that begin or end with a hyphen have no word
    boundary there and aren't looked for.
    """
    known = lookup.where(F.col("name").rlike("^[a-z0-9](.*[a-z0-9])?$"))
    lengths = sorted(r[0] for r in known.select(F.size(F.regexp_extract_all("name", F.lit(WORD), F.lit(0)))).distinct().collect())  # a few numbers
    # pieces are words and what lies between by turns; a run of n words is 2 n - 1 pieces
    cut_ = F.regexp_extract_all("text", F.lit(f"{WORD}|[^a-z0-9]+"), F.lit(0))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: texts are small for the work they make
    clean = texts.select(key, "text").repartition(parts, key).select(key, normalize_text(F.col("text")).alias("text")).withColumn("pieces", cut_)
    run = lambda n: F.concat(*[F.get("pieces", F.col("i") + j) for j in range(2 * n - 1)])  # noqa: E731  # null beyond the end
    runs = clean.select(key, "pieces", F.posexplode("pieces").alias("i", "word")).where(F.col("word").rlike("^[a-z0-9]"))
    runs = runs.select(key, "i", F.explode(F.array(*[run(n) for n in lengths]) if lengths else F.array().cast("array<string>")).alias("name"))
    at = runs.join(known.select("name", "term"), "name").groupBy(key).agg(F.collect_list(F.struct("i", "term", "name")).alias("at"))
    met = clean.join(at, key).select(key, "text", "pieces", F.explode("at").alias("x")).select(key, "text", "x.term", "x.name", F.char_length(F.array_join(F.slice("pieces", 1, F.col("x.i")), "")).alias("start"))
    found = met.select(key, "term", "name", "start", is_negated(F.col("text"), F.col("start")).alias("negated"))
    # from left to right, one that begins inside the last one taken doesn't count
    listed = found.groupBy(key, "term", "name").agg(F.array_sort(F.collect_list(F.struct("start", "negated"))).alias("at"))
    none = F.array().cast("array<struct<start:int,negated:boolean>>")
    taken = F.aggregate(
        "at", F.struct(none.alias("got"), F.lit(0).alias("free")),
        lambda s, x: F.when(x["start"] >= s["free"], F.struct(F.array_append(s["got"], x).alias("got"), (x["start"] + F.char_length("name")).alias("free"))).otherwise(s),
        lambda s: s["got"],
    )
    out = listed.select(key, "term", "name", F.explode(taken).alias("x"))
    out = out.select(key, "term", F.col("name").alias("matched_text"), F.lit("dictionary").alias("method"), F.lit(1.0).alias("confidence"), "x.start", (F.col("x.start") + F.char_length("name")).alias("end"), "x.negated")
    return out.where("not negated") if skip_negated else out


def _grams(text: str) -> Column:
    """All substrings of one to GRAM characters with their length in front, and their places (from 1)."""
    every = f"flatten(transform(sequence(1, {GRAM}), g -> transform(sequence(1, greatest(char_length({text}) - g + 1, 1)), i -> struct(concat(g, ':', substring({text}, i, g)) AS h, i))))"
    return F.explode(F.expr(every))


def _head(text: str) -> Column:
    """The first GRAM characters, or all, with their number in front."""
    return F.expr(f"concat(least(char_length({text}), {GRAM}), ':', substring({text}, 1, {GRAM}))")


def containing(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of distinct ``phrase`` and ``name`` of which one contains the other; blank ones contain nothing here."""
    p = phrases.select("phrase").where("phrase <> ''").distinct()
    n = names.select("name").where("name <> ''").distinct()
    inside, around = _inside(p.toDF("short"), n.toDF("long")), _inside(n.toDF("short"), p.toDF("long"))
    return inside.toDF("phrase", "name").unionByName(around.toDF("name", "phrase")).distinct()


def _inside(short: DataFrame, long: DataFrame) -> DataFrame:
    """``short, long`` where the first lies in the second.

    First characters of the shorter ones, with the lengths that begin so, tell where in
    the longer ones to look; what stands there is joined whole, so beginnings that
    many share make no pairs.
    """
    heads = short.select(_head("short").alias("h"), F.char_length("short").alias("n")).distinct()
    at = long.select("long", _grams("long").alias("x")).select("long", "x.h", "x.i").join(heads, "h")
    found = at.where(F.col("i") + F.col("n") - 1 <= F.char_length("long")).select(F.substring("long", F.col("i"), F.col("n")).alias("short"), "long").distinct()
    return found.join(short, "short").select("short", "long")


def match_phrases(phrases: DataFrame, lookup: DataFrame, rule: str) -> DataFrame:
    """``phrases (phrase, ...)`` with the term of their label; phrases without one go.

    A label equal to the normalised phrase counts first, then the first label that
    contains it or lies in it, if both are long enough.
    """
    least_label, least_phrase = RULES[rule]
    named = phrases.withColumn("name_", normalize_text(F.col("phrase"))).where("name_ <> ''")
    exact = lookup.select(F.col("name").alias("name_"), F.col("term").alias("exact"))
    long = lookup.where(F.char_length("name") >= least_label)
    asked = named.where(F.char_length("name_") >= least_phrase).select(F.col("name_").alias("phrase"))
    near = containing(asked, long).join(long, "name").groupBy("phrase").agg(F.min(F.struct("ord", "term"))["term"].alias("near"))
    out = named.join(exact, "name_", "left").join(near.withColumnRenamed("phrase", "name_"), "name_", "left")
    return out.withColumn("term", F.coalesce("exact", "near")).where("term is not null").drop("name_", "exact", "near")


def deduplicate(found: DataFrame, key: str, blocked: DataFrame | None = None) -> DataFrame:
    """The most confident row of each term of a key, the first (``ord``) of equals, without blocked terms; ``place`` orders them by start."""
    if blocked is not None:
        found = found.join(blocked.select("term"), "term", "left_anti")
    first = Window.partitionBy(key, "term").orderBy(F.desc("confidence"), "ord")
    best = found.withColumn("r_", F.row_number().over(first)).where("r_ = 1").drop("r_")
    return best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("start", F.lit(0)), "term")))


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row for each key, term and method; the new row replaces an old one."""
    return old.join(new.select(key, "term", "method").distinct(), [key, "term", "method"], "left_anti").unionByName(new)


def summary(cases: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: cases, mean, least and most terms of a case, cases without terms."""
    n = found.groupBy(key).agg(F.count_distinct("term").alias("n"))
    per = cases.select(key).distinct().join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return per.agg(F.count("*").alias("n_cases"), F.round(F.avg("n"), 4).alias("mean_terms"), F.min("n").alias("least_terms"), F.max("n").alias("most_terms"), F.count_if(F.col("n") == 0).alias("n_empty"))


def per_method(found: DataFrame) -> DataFrame:
    return found.groupBy("method").agg(F.count("*").alias("n_found"), F.count_distinct("term").alias("n_terms"))


#: Extractors by name: (texts, key, lookup) -> found terms.  Those that need a model or a service are registered by their users.
EXTRACTORS: dict[str, Callable[[DataFrame, str, DataFrame], DataFrame]] = {"dictionary": dictionary}


def ensemble(texts: DataFrame, key: str, labels: DataFrame, methods: list[str] = ("dictionary",), blocked: DataFrame | None = None) -> DataFrame:
    """The selected extractors' terms, the most confident row of each; unknown names raise ValueError."""
    unknown = [m for m in methods if m not in EXTRACTORS]
    if unknown or not methods:
        raise ValueError(f"unknown or no extractors: {unknown}")
    lookup, found = label_lookup(labels), None
    for i, m in enumerate(methods):
        rows = EXTRACTORS[m](texts, key, lookup).withColumn("ord", F.struct(F.lit(i).alias("m"), F.coalesce("start", F.lit(0)).alias("s")))
        found = rows if found is None else found.unionByName(rows)
    return deduplicate(found, key, blocked).drop("ord")


def label_budget(rows: DataFrame, key: str, least_ic: float = 1.5, budget: int = 650, separator: int = 2) -> DataFrame:
    """The most informative labels ``key, term, label, ic`` that fit a prompt of ``budget`` characters.

    Only terms of ``least_ic`` or more count, or all where a key has none of them.
    A label takes its length and a separator, so few rows of a key can fit and the
    others go before rows meet.
    """
    some = rows.where(F.col("ic") >= least_ic).select(key).distinct().withColumn("some_", F.lit(True))
    kept = rows.join(some, key, "left").where((F.col("ic") >= least_ic) | F.col("some_").isNull()).drop("some_")
    order = Window.partitionBy(key).orderBy(F.desc("ic"), "term")
    near = kept.withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= budget // separator + 1).drop("r_")
    upto = F.sum(F.char_length("label") + separator).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("used_", upto).where(F.col("used_") <= budget).drop("used_")
