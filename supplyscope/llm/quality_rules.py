"""Quality rules by distribution divergence, in DataFrame functions only.

Every document gets two histograms: shares of seven character classes, and shares of its
language's `COMMON` most frequent words (and one cell for all others). Both the common words and the
references come from all documents: words by their count, references as the mean of the documents'
own shares, so that one giant document weighs no more than another. A document is rejected when its
Jensen-Shannon distance (base 2, 0 to 1) to its language is above a limit. Short texts have noisy
histograms, hence the guards: fewer characters or words than the minimum, no verdict from that test.

Repetition is counted with hashed 8-word windows inside the row; only texts in which a window comes
twice are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.plans.shared import settle

COMMON, REPEAT_WINDOW = 24, 8
CHAR_LIMIT, WORD_LIMIT = 0.30, 0.50
MIN_CHARS, MIN_WORDS, MIN_REFERENCE_DOCS = 200, 50, 20
SPACE = r"\x20\x09-\x0D"
#: taken off one after the other; what is left at the end is the last class
CLASSES = (("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("mark", r"[.,;:'\"!?()-]+"), ("beyond", r"[^\x00-\x7F]+"))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def language(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = COMMON) -> DataFrame:
    """(language, common): the most frequent words of each language, over all documents."""
    words = docs.select(language(lang_col).alias("language"), F.explode(words_of(F.col(text_col))).alias("word"))
    counts = words.groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))
    best = counts.withColumn("place", place).where(F.col("place") <= top)
    listed = F.sort_array(F.collect_list(F.struct("place", "word")))
    return best.groupBy("language").agg(F.transform(listed, lambda x: x["word"]).alias("common"))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words of `w` inside windows that come at least twice."""
    n, size = REPEAT_WINDOW, F.size("w")
    windows = F.when(size > n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.xxhash64(F.slice("w", i, n))))
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ordered = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    beside = lambda x, k: F.coalesce(F.get("ordered", k)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("ordered", lambda x, k: beside(x, k - 1) | beside(x, k + 1)), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + s + n - F.greatest(acc["end"], s)).alias("n"), (s + n).alias("end"))
    out = df.withColumn("hashes", windows).withColumn("ordered", F.when(twice, ordered))
    total = F.aggregate(starts, zero, step, lambda acc: acc["n"])
    return out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("ordered").isNotNull(), total), F.lit(0)).cast("long")).drop("hashes", "ordered")


def _times(codes: str, code: int) -> Column:
    found = F.size(F.filter(codes, lambda c: c == code))
    return F.greatest(found, F.lit(0)).cast("long")  # -1 where the language has no list


def features(docs: DataFrame, common: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), language(lang_col).alias("language"), F.xxhash64(text_col).alias("row_hash"), text.alias("t"))
    df = df.join(common, "language", "left")
    df = df.withColumn("w", words_of(F.col("t"))).withColumn("n_chars", F.length("t").cast("long"))
    df = df.withColumn("n_words", F.size("w").cast("long")).withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.col("n_chars") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", "")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = df.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    df = _repeat_words(df)
    spaces = F.col("n_chars") - F.col("word_chars")
    df = df.withColumn("rest0", F.regexp_replace("t", f"[a-z{SPACE}]+", ""))
    counts = [F.col("n_chars") - spaces - F.length("rest0"), spaces]
    for k, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"rest{k + 1}", F.regexp_replace(f"rest{k}", pattern, ""))
        counts.append(F.length(f"rest{k}") - F.length(f"rest{k + 1}"))
    counts.append(F.length(f"rest{len(CLASSES)}"))
    df = df.withColumn("chars", F.array(*[c.cast("long") for c in counts]))
    df = df.withColumn("codes", F.filter(F.transform("w", lambda x: F.array_position("common", x)), lambda c: c > 0))
    df = df.withColumn("hits", F.array(*[_times("codes", k + 1) for k in range(COMMON)]))
    return df.select("id", "row_hash", "language", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "hits")


def _shares(df: DataFrame) -> DataFrame:
    others = F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x)
    share = lambda cells, n: F.transform(cells, lambda x: x / F.greatest(n, F.lit(1)))
    return df.withColumns({"p_chars": share(F.col("chars"), F.col("n_chars")), "p_words": share(F.concat("hits", F.array(others)), F.col("n_words"))})


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two equally long share arrays."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
    min_docs: int = MIN_REFERENCE_DOCS,
) -> DataFrame:
    """(id, row_hash, counts, js_chars, js_words, base_failed, kept), a row for each row of `docs`.

    Null text is empty, and fails as too short. Null and empty languages are one language. A language
    with fewer than `min_docs` documents long enough has no reference: no verdict from the divergence.
    """
    common = settle(common_words(docs, text_col, lang_col))
    own = settle(features(docs, common, id_col, text_col, lang_col))
    shares = _shares(own)
    long_enough = shares.where((F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words))
    mean = lambda name, n: F.array(*[F.avg(F.get(name, F.lit(k))) for k in range(n)])
    refs = long_enough.groupBy("language").agg(
        mean("p_chars", len(CLASSES) + 3).alias("r_chars"), mean("p_words", COMMON + 1).alias("r_words"), F.count(F.lit(1)).alias("n")
    )
    refs = settle(refs.where(F.col("n") >= min_docs).drop("n"))
    met = shares.join(refs, "language", "left")
    met = met.withColumns({"js_chars": js_distance(F.col("p_chars"), F.col("r_chars")), "js_words": js_distance(F.col("p_words"), F.col("r_words"))})
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = [
        (F.col("n_chars") >= min_chars) & (F.col("js_chars") > char_limit),
        (F.col("n_words") >= min_words) & (F.col("js_words") > word_limit),
    ]
    rejected = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in far])
    met = met.withColumns({"base_failed": failed, "kept": ~failed & ~rejected})
    names = ("n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_chars", "js_words", "base_failed", "kept")
    return met.select(F.col("id").alias(id_col), "row_hash", *names)


def op8_quality_rules(spark, sf_dir):
    rows = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
