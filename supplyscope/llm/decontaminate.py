"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is 13 consecutive words of a benchmark item (the whole item if it has fewer). A window
that occurs in a document shares all its words with it, so the necessary prefix is one word: its
rarest, by the word's count over all documents. Neighbouring windows of an item mostly have the
same rarest word; they are one entry (word, position, windows lo to hi), about two for every 14
words of an item. Entries are joined to document words by equality. The word's position gives the
only place where the window can lie, the bounds drop places that reach over the document's ends,
and the words there are compared one by one.

The entries follow the benchmark's size, not the corpus. They are broadcast while a measured
bound holds (`BROADCAST_BYTES`), and the words of a document then stay in its row. Beyond that
only (row, position, word) is shuffled, and candidates meet their document again for the proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.llm.common import LOWER, UPPER, lower_ascii
from supplyscope.plans.shared import settle

WINDOW = 13
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 16 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS), "")


def prefix_entries(docs: DataFrame, items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(token, item, q, lo, hi, len, part): windows lo to hi of an item, all with their rarest word at q."""
    texts = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    texts = settle(texts.where(F.size("words") > 0).distinct().withColumn("uid", F.xxhash64("item", "words")))
    vocabulary = settle(texts.select(F.explode("words").alias("token")).distinct())
    tokens = docs.select(F.explode(words_of(F.col(text_col))).alias("token"))
    counts = tokens.join(vocabulary, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    placed = texts.select("uid", F.posexplode("words").alias("pos", "token")).join(counts, "token", "left")
    order = F.sort_array(F.collect_list(F.struct("pos", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("pos").alias("q")).alias("rarity"))))
    ranked = placed.groupBy("uid").agg(F.transform(order, lambda x: x["rarity"]).alias("rarity"))
    size = F.least(F.lit(window), F.size("words"))
    joined = texts.join(ranked, "uid").withColumn("len", size)
    starts = F.sequence(F.lit(0), F.size("words") - F.col("len"))
    least = F.transform(starts, lambda j: F.struct(F.array_min(F.slice("rarity", j + 1, F.col("len")))["q"].alias("q"), j.alias("j")))
    each = joined.select("uid", "item", "words", "len", F.explode(least).alias("w"))
    spans = each.groupBy("uid", F.col("w.q").alias("q")).agg(F.min("w.j").alias("lo"), F.max("w.j").alias("hi"))
    part = F.slice("words", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("len"))
    token = F.element_at("words", F.col("q") + 1)
    return joined.join(spans, "uid").select(token.alias("token"), "item", "q", "lo", "hi", "len", part.alias("part"))


def _proved() -> Column:
    """Spans (a, b) in `words` where windows of the entry occur, for the entry's word at `p`."""
    first = F.col("p") - F.col("q") + F.col("lo")

    def at(d: Column) -> Column:
        a = first + d
        inside = (a >= 0) & (a + F.col("len") <= F.size("words"))
        same = F.when(inside, F.slice("words", a + 1, F.col("len")) == F.slice("part", d + 1, F.col("len")))
        return F.when(same, F.struct(a.alias("a"), (a + F.col("len")).alias("b")))

    return F.filter(F.transform(F.sequence(F.lit(0), F.col("hi") - F.col("lo")), at), lambda x: x.isNotNull())


def covered(spans: Column) -> Column:
    """Places inside at least one of the spans (a, b)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end")
    )
    return F.aggregate(F.sort_array(spans), start, step, lambda acc: acc["n"])


def benchmark_hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, row_hash, n_words, n_hit, items): words, words inside an item's window, and the items with one.

    A row for each row of `docs`. `row_hash` is the hash of the text, so that rows which share an id
    keep their own result; repeated rows get equal results. Null and empty texts have no words. Words
    of an item without id are hit, but it is no item of the list. Empty benchmark: nothing is hit.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    row_hash = F.xxhash64(F.col(text_col)).alias("row_hash")
    entries = settle(prefix_entries(docs, items, item_col, text_col, window))
    measured = entries.agg(F.sum(F.length(F.array_join("part", " ")) + F.size("part") * 24 + 200)).first()[0] or 0
    split = docs.select("id", row_hash, words_of(F.col(text_col)).alias("words"))
    if measured <= broadcast_bytes:
        places = split.select("id", "row_hash", "words", F.posexplode("words").alias("p", "token"))
        met = places.join(F.broadcast(entries), "token")
    else:
        places = split.select("id", "row_hash", F.posexplode("words").alias("p", "token"))
        found = places.join(entries, "token").withColumnsRenamed({"id": "c_id", "row_hash": "c_hash"}).distinct()
        same = split["id"].eqNullSafe(found["c_id"]) & (split["row_hash"] == found["c_hash"])
        met = split.distinct().join(found, same)
    # no filter on the spans here: it would move into the join, which then leaves the generated code and
    # copies the words of a document once for each of its words
    spans = met.select("id", "row_hash", "item", _proved().alias("spans"))
    hits = spans.groupBy(F.col("id").alias("h_id"), F.col("row_hash").alias("h_hash")).agg(
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"), F.sort_array(F.collect_set(F.when(F.size("spans") > 0, F.col("item")))).alias("items")
    )
    hits = hits.where(F.size("spans") > 0)
    counted = hits.select("h_id", "h_hash", covered(F.col("spans")).alias("n_hit"), "items")
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_RUN)).cast("long").alias("n_words")
    base = docs.select("id", row_hash, n_words)
    same = base["id"].eqNullSafe(counted["h_id"]) & (base["row_hash"] == counted["h_hash"])
    return base.join(counted, same, "left").select(
        F.col("id").alias(id_col), "row_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op3_decontaminate(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return benchmark_hits(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, contaminated().alias("contaminated")
    )


ORACLE = rf"""
with item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
 win as (
  select distinct item_id, least(13, len(w)) as l, array_to_string(w[j + 1 : j + least(13, len(w))], ' ') as s
  from item, unnest(range(0, len(w) - least(13, len(w)) + 1)) as u(j) where len(w) > 0),
 doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
 place as (
  select doc_id, l, j, array_to_string(w[j + 1 : j + l], ' ') as s
  from doc, (select distinct l from win) as sizes, unnest(range(0, len(w) - l + 1)) as u(j) where len(w) >= l),
 hit as (select doc_id, item_id, p.l, j from place p join win using (s, l)),
 pos as (select doc_id, count(distinct j + k) as n_hit from hit, unnest(range(0, l)) as u(k) group by doc_id),
 its as (
  select doc_id, count(*) as n_items, sha256(string_agg(i, ',' order by i)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join pos using (doc_id) left join its using (doc_id)
"""
