"""Quality rules by distribution divergence, in DataFrame functions only
(operator 8).

Every document is described by two histograms: character classes and the most
common words of its language (with one bin for all other words).  Both are
compared with the histograms of all documents of that language by the
Jensen-Shannon distance (base 2, so from 0 to 1).  A histogram of few
observations is mostly noise, so each comparison has a minimum length below
which it is not made.  The references are sums over the whole table; only the
common words of a language (``common`` per language) come to the driver.

Defined cases: null text is empty text; a null language is a language of its
own; repeated rows each get their row; a table without rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: character classes in the order in which they are taken out of a text
CLASSES = ["lower", "space", "upper", "digit", "symbol", "mark", "other"]

#: regular expressions of the ASCII classes; what is left is "other"
CLASS_PATTERNS = {"lower": "[a-z]+", "space": "[\\x20\\x09-\\x0D]+", "upper": "[A-Z]+", "digit": "[0-9]+",
                  "symbol": "[#*$%&|<>]+", "mark": "[\\x00-\\x7F]+"}


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add _words (array), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and _chars (counts by character class)."""
    df = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rest, lengths = F.col("_text"), []
    for name, pattern in CLASS_PATTERNS.items():
        df = df.withColumn(f"_r_{name}", F.regexp_replace(rest, pattern, ""))
        lengths.append(F.length(rest) - F.length(f"_r_{name}"))
        rest = F.col(f"_r_{name}")
    lengths.append(F.length(rest))
    has_word = F.col("_text").rlike("[^\\x20\\x09-\\x0D]")
    df = df.select(
        *docs.columns, "_text", F.array(*[x.cast("double") for x in lengths]).alias("_chars"),
        F.when(has_word, F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
         .otherwise(F.array().cast("array<string>")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"))
    windows = F.when(F.size("_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_windows", windows)
    placed = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"),
                    F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_placed", placed)
    found = F.filter("_placed", lambda x, k: (x["h"] == F.get("_placed", k + 1)["h"])
                     | ((k > 0) & (x["h"] == F.get("_placed", k - 1)["h"])))
    df = df.withColumn("_found", F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(
        "_found", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"])
    chars = dict(zip(CLASSES, range(len(CLASSES))))
    total = F.aggregate("_chars", F.lit(0.0), lambda a, x: a + x)
    return df.select(
        *docs.columns, "_words", "_chars",
        F.size("_words").cast("long").alias("n_words"),
        (total - F.col("_chars")[chars["space"]]).cast("long").alias("word_chars"),
        F.col("_chars")[chars["symbol"]].cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def language_references(docs: DataFrame, common: int = 20, text_col: str = "text",
                        lang_col: str = "lang") -> DataFrame:
    """One row per language: common (words, most frequent first, ties by
    word), word_share (of each, and of all other words) and char_share."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    plain = docs.select(lang, text)
    rest, lengths = F.col("_text"), []
    chars = plain
    for name, pattern in CLASS_PATTERNS.items():
        chars = chars.withColumn(f"_r_{name}", F.regexp_replace(rest, pattern, ""))
        lengths.append(F.sum(F.length(rest) - F.length(f"_r_{name}")))
        rest = F.col(f"_r_{name}")
    lengths.append(F.sum(F.length(rest)))
    by_class = chars.groupBy("_lang").agg(F.array(*[x.cast("double") for x in lengths]).alias("_n"))
    counts = (plain.select("_lang", F.explode(F.split("_text", "[\\x20\\x09-\\x0D]+")).alias("w"))
              .filter("w <> ''").groupBy("_lang", "w").agg(F.count("*").alias("n")))
    top = _top_words(counts, common)
    total = F.aggregate("_n", F.lit(0.0), lambda a, x: a + x)
    named = F.aggregate("_top", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return (by_class.join(top, "_lang", "left").select(
        "_lang", F.transform("_n", lambda x: x / F.greatest(total, F.lit(1.0))).alias("char_share"),
        F.coalesce(F.transform("_top", lambda x: x["w"]), F.array().cast("array<string>")).alias("common"),
        F.coalesce(F.concat(F.transform("_top", lambda x: x["n"] / F.col("_all")),
                            F.array((F.col("_all") - named) / F.col("_all"))),
                   F.array(F.lit(1.0))).alias("word_share")))


def _top_words(counts: DataFrame, common: int) -> DataFrame:
    """(_lang, _all, _top): the number of words and the most frequent ones.
    ``row_number() <= k`` keeps k rows a task before the shuffle."""
    w = Window.partitionBy("_lang").orderBy(F.desc("n"), "w")
    top = (counts.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= common)
           .groupBy("_lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "n", "w"))),
                                             lambda x: F.struct(x["n"].alias("n"), x["w"].alias("w"))).alias("_top")))
    return top.join(counts.groupBy("_lang").agg(F.sum("n").alias("_all")), "_lang")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two share arrays of one length."""
    def part(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / total)


def quality_verdict(docs: DataFrame, common: int = 20, min_chars: int = 250, min_words: int = 50,
                    max_char_distance: float = 0.31, max_word_distance: float = 0.42,
                    base_min_words: int = 50, base_max_repeat: float = 0.5,
                    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, the counts, base_failed, char_distance, word_distance (null
    below the minimum length) and kept."""
    base = docs.select(F.col(id_col), F.col(text_col).alias("_doc"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang"))
    refs = language_references(docs, common, text_col, lang_col).collect()   # one short row a language
    known = sorted({w for r in refs for w in r["common"]})
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(r["_lang"], r["char_share"], r["common"], r["word_share"]) for r in refs],
        "_lang string, char_share array<double>, common array<string>, word_share array<double>")
    df = text_counts(base, "_doc")
    is_common = F.filter("_words", lambda w: w.isin(known)) if known else F.array().cast("array<string>")
    df = df.withColumn("_hits", is_common).join(F.broadcast(table), "_lang")
    hits = F.transform("common", lambda c: F.size(F.filter("_hits", lambda w: w == c)).cast("double"))
    df = df.withColumn("_named", hits)
    named = F.aggregate("_named", F.lit(0.0), lambda a, x: a + x)
    word_bins = F.concat("_named", F.array(F.col("n_words") - named))
    chars = F.aggregate("_chars", F.lit(0.0), lambda a, x: a + x)
    df = df.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.col("word_chars") >= min_chars,
               js_distance(_shares(F.col("_chars"), chars), F.col("char_share"))).alias("char_distance"),
        F.when(F.col("n_words") >= min_words,
               js_distance(_shares(word_bins, F.col("n_words")), F.col("word_share"))).alias("word_distance"))
    failed = (F.col("n_words") < base_min_words) | (
        F.col("n_repeat_words") > base_max_repeat * F.col("n_words"))
    near = (F.coalesce(F.col("char_distance") <= max_char_distance, F.lit(True))
            & F.coalesce(F.col("word_distance") <= max_word_distance, F.lit(True)))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & near)
