"""Quality rules by distribution divergence, in column expressions only.

A document's histograms of character classes and of common words are compared
with references of its language by the Jensen-Shannon distance (base 2, 0 to 1).
References are sums over all documents of a language.  Short documents, whose
histograms say little, are guarded by minimum lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, remove

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Character classes; what is in none of them and isn't white space is ``other``.
CLASSES = {
    "lower": r"\p{Ll}",
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "stop": r"[.,;:?'\"()\-]",
    "bang": r"[!]",
    "symbol": r"[#*$%&|<>]",
}
COMMON_WORDS = 16
MAX_LANGUAGES = 256
ALL = "*"  # the reference over all documents, for rows of no or a rare language


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def base_columns(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, _t (text), _w (words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Windows of three words are compared by a 64-bit hash of the words.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(*keep, text.alias("_t"))
    d = d.withColumn("_w", _words(F.col("_t")))
    d = d.withColumn("_g", F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2)))"))
    d = d.withColumn("_d", F.expr("CASE WHEN size(array_distinct(_g)) < size(_g) THEN sort_array(transform(_g, (g, i) -> struct(g, i))) ELSE array() END"))
    # starts of the windows that occur twice or more, in order
    d = d.withColumn("_p", F.expr("sort_array(transform(filter(transform(_d, (s, i) -> struct(s.i AS i, (i > 0 AND get(_d, i - 1).g = s.g) OR coalesce(get(_d, i + 1).g = s.g, false) AS twice)), s -> s.twice), s -> s.i))"))
    d = d.withColumn("_l", F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    n_repeat = F.expr("CASE WHEN size(_p) = 0 THEN 0L ELSE aggregate(transform(_p, (x, k) -> least(3, coalesce(get(_p, k + 1), x + 3) - x)), 0L, (s, x) -> s + x) END")
    d = d.select(
        *keep, "_t", "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(CLASSES["symbol"])).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def class_counts(text: str, rest: str) -> list[Column]:
    """Characters of each class; ``rest`` is the text without its runs of the class ``lower``."""
    lower = (F.char_length(text) - F.char_length(rest)).cast("long").alias("_c_lower")
    return [lower, *[F.regexp_count(rest, F.lit(p)).cast("long").alias(f"_c_{k}") for k, p in CLASSES.items() if k != "lower"]]


def word_references(docs: DataFrame, common_words: int = COMMON_WORDS) -> dict[str, tuple[list[str], list[float]]]:
    """By language the commonest words, and the shares of these and of all others.

    All documents count.  The ``MAX_LANGUAGES`` languages with most words get a
    reference, and ``*`` has all documents together.
    """
    words = docs.select(F.coalesce("lang", F.lit(ALL)).alias("lang"), F.explode(_words(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = materialize(words, "rule-words")
    chosen = words.where(F.col("lang") != ALL).groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).select("lang")
    all_words = words.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "word", "n")
    ranked = words.join(F.broadcast(chosen), "lang").select("lang", "word", "n").unionByName(all_words)
    top = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= common_words)
    counts = {r[0]: r[1] for r in ranked.groupBy("lang").agg(F.sum("n")).collect()}
    out: dict[str, tuple[list[str], list[float]]] = {lang: ([], []) for lang in [ALL, *counts]}
    for r in top.orderBy("lang", "r").collect():
        out[r["lang"]][0].append(r["word"])
        out[r["lang"]][1].append(r["n"] / counts[r["lang"]])
    for _, shares in out.values():
        shares.append(max(0.0, 1.0 - sum(shares)))
    remove(words, docs.sparkSession)
    return out


def class_references(counted: DataFrame) -> dict[str, list[float]]:
    """By ``_lang`` the shares of the character classes, ``other`` last; ``*`` has all rows."""
    sums = {r["_lang"]: [r["n"] or 0, *[r[f"_c_{k}"] or 0 for k in CLASSES]] for r in counted.groupBy("_lang").agg(F.sum("word_chars").alias("n"), *[F.sum(f"_c_{k}").alias(f"_c_{k}") for k in CLASSES]).collect()}
    sums[ALL] = [sum(x) for x in zip(*sums.values(), strict=True)] if sums else [0] * (len(CLASSES) + 1)
    out = {}
    for lang, (n, *parts) in sums.items():
        shares = [x / max(n, 1) for x in parts]
        out[lang] = [*shares, max(0.0, 1.0 - sum(shares))]
    return out


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two array columns of shares."""
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0D END"
    terms = f"zip_with({p}, {q}, (x, y) -> ({part.format('x', 'y')} + {part.format('y', 'x')}) / 2)"
    return F.expr(f"sqrt(greatest(aggregate({terms}, 0D, (s, t) -> s + t), 0D))")


def quality_rules(
    docs: DataFrame, max_classes: float = 0.28, max_words: float = 0.4, min_chars: int = 200, min_words: int = 50, common_words: int = COMMON_WORDS
) -> DataFrame:
    """Base counts and the verdict for every row, without a shuffle of texts.

    Columns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, js_classes, js_words.  ``kept`` is false if the base rules
    fail, or a distance to the language's reference is over its limit: that of
    character classes in documents of ``min_chars`` characters or more, that of
    common words in documents of ``min_words`` words or more.  A null text has no
    words and fails; a null or unknown language is held against all documents
    together; repeated rows repeat; an empty table gives no rows.
    """
    spark = docs.sparkSession
    refs = word_references(docs, common_words)
    table = spark.createDataFrame([(k, *r) for k, r in refs.items()], "_ref string, _words array<string>, _shares array<double>")  # MAX_LANGUAGES rows and one at most
    lang = F.when(F.col("lang").isin([k for k in refs if k != ALL]), F.col("lang")).otherwise(F.lit(ALL))
    d = base_columns(docs.withColumn("_lang", lang), ["doc_id", "_lang"])
    d = d.withColumn("_rest", F.regexp_replace("_t", CLASSES["lower"] + "+", "")).join(F.broadcast(table), F.col("_lang") == F.col("_ref"), "left")
    # the inner list is bound by a lambda, so it is made once and not for each common word
    found = "filter(transform(_w, w -> lower(w)), w -> array_contains(_words, w))"
    hits = f"get(transform(array({found}), l -> transform(_words, w -> size(filter(l, f -> f = w)) / greatest(n_words, 1))), 0)"
    names = ["doc_id", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    d = materialize(d.select(*names, *class_counts("_t", "_rest"), F.expr(hits).alias("_o"), "_shares"), "rule-counts")  # numbers only
    classes = spark.createDataFrame(list(class_references(d).items()), "_ref string, _classes array<double>")
    d = d.join(F.broadcast(classes), F.col("_lang") == F.col("_ref"), "left")
    n = F.greatest("word_chars", F.lit(1))
    d = d.withColumn("_s", F.array(*[F.col(f"_c_{k}") / n for k in CLASSES]))
    rest = "concat({0}, array(greatest(0D, 1 - aggregate({0}, 0D, (s, t) -> s + t))))"
    d = d.withColumns({"_s": F.expr(rest.format("_s")), "_o": F.expr(rest.format("_o"))})
    d = d.withColumns({"js_classes": js_distance("_s", "_classes"), "js_words": js_distance("_o", "_shares")})
    odd = ((F.col("word_chars") >= min_chars) & (F.coalesce("js_classes", F.lit(0.0)) > max_classes)) | (
        (F.col("n_words") >= min_words) & (F.coalesce("js_words", F.lit(0.0)) > max_words)
    )
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~odd).alias("kept"), "js_classes", "js_words",
    )
