"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text.

Symbols are the UTF-16 units of a text, after three start symbols and before an end symbol, so a
4-gram is one long: its context and its suffix are shifts and masks of it. The model is fitted on all
documents that the labels call good and not toxic. Lower orders count distinct left
neighbours; each order has its own three discounts from its counts of counts. Every step of it is an
aggregation or an equality join of counts.

All documents are scored. A block of rows sends its distinct 4-grams to shards; the shards' distinct
4-grams are looked up in the model order by order, and the logarithms go back to the blocks, where
they are added up by document. A document is kept while its perplexity is at most its language's
limit: a quantile of all trusted documents of that language, times a margin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.llm import blobs
from supplyscope.plans.shared import settle

ORDER, BLOCK, GROUP = 4, 1024, 1 << 20
QUANTILE, MARGIN, MIN_UNITS = 0.99, 1.25, 100
FIRST, LAST = 2, 3


def grams(texts: list[bytes]):
    """Groups (4-grams as uint64, place of the text of each run, length of each run) of bounded size."""
    keys, where, sizes, held = [], [], [], 0
    for k, text in enumerate(texts):
        units = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-16-le", "surrogatepass"), "<u2")
        units = np.concatenate([np.full(ORDER - 1, FIRST, "<u2"), units, np.array([LAST], "<u2")]).astype(np.uint64)
        for low in range(0, len(units) - ORDER + 1, GROUP):
            part = units[low : low + GROUP + ORDER - 1]
            n = len(part) - ORDER + 1
            key = np.zeros(n, np.uint64)
            for j in range(ORDER):
                key = key << np.uint64(16) | part[j : j + n]
            keys.append(key)
            where.append(k)
            sizes.append(n)
            held += n
            if held >= GROUP:
                yield np.concatenate(keys), where, sizes
                keys, where, sizes, held = [], [], [], 0
    if keys:
        yield np.concatenate(keys), where, sizes


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import pandas as pd

    found, counts = [], []
    for keys, _, _ in grams(texts):
        codes, some = pd.factorize(keys)
        found.append(some)
        counts.append(np.bincount(codes, minlength=len(some)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, inverse = np.unique(np.concatenate(found), return_inverse=True)
    return keys, np.bincount(inverse.reshape(-1), np.concatenate(counts), len(keys)).astype(np.int64)


def _in_blocks(batches, columns: int):
    """(block, lists of the other columns): rows of one block, which follow each other."""
    now, held = None, [[] for _ in range(columns)]
    for batch in batches:
        for block, *row in zip(*(batch.column(k).to_pylist() for k in range(columns + 1))):
            if block != now and held[0]:
                yield now, held
                held = [[] for _ in range(columns)]
            now = block
            for cells, x in zip(held, row):
                cells.append(x)
    if held[0]:
        yield now, held


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    return (((mixed >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


def _by_shard(texts: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 4-grams by shard, then key, and the cuts between shards."""
    keys, _ = _distinct(texts)
    shard = _shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    return keys[order], np.searchsorted(shard[order], np.arange(shards + 1))


def count_grams(placed: DataFrame) -> DataFrame:
    """(gram, c) of all texts of (block, text); with a column `mark`, its sum over the rows is that over the grams."""
    extra = placed.columns[2:]

    def run(batches):
        for _, (texts, *marks) in _in_blocks(batches, 1 + len(extra)):
            keys, counts = _distinct(texts)
            columns = [keys.view(np.int64), counts, *[np.append(sum(m), np.zeros(len(keys) - 1, np.int64)) for m in marks]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["gram", "c", *extra])

    names = ["c", *extra]
    return placed.mapInArrow(run, "gram long" + "".join(f", {n} long" for n in names)).groupBy("gram").agg(*[F.sum(n).alias(n) for n in names])


def _mask(order: int) -> Column:
    return F.lit((1 << 16 * order) - 1)


class Model:
    """Written tables: p[k] (gram, p) and gamma[k] (context, gamma) for orders 1 to `ORDER`; unknown: p of a new symbol."""

    def __init__(self, counts: DataFrame):
        level = {ORDER: settle(counts)}
        self.counts = level[ORDER]
        for k in range(ORDER - 1, 0, -1):
            level[k] = settle(level[k + 1].groupBy(F.col("gram").bitwiseAND(_mask(k)).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
        self.p, self.gamma = {}, {}
        for k in range(1, ORDER + 1):
            n = [F.sum(F.when(F.col("c") == j, 1).otherwise(0)).alias(f"n{j}") for j in (1, 2, 3, 4)]
            row = level[k].agg(*n, F.count(F.lit(1)).alias("kinds")).first()
            n1, n2, n3, n4 = ((row[j] or 0) for j in range(4))
            y = n1 / max(1, n1 + 2 * n2)
            d = [min(max(j - (j + 1) * y * b / max(1, a), 0.05), j - 0.05) for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
            context = F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long")
            rows = level[k].withColumn("context", context)
            sums = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum(cut).alias("freed"))
            self.gamma[k] = settle(sums.select("context", "total", (F.col("freed") / F.col("total")).alias("gamma")))
            met = rows.join(self.gamma[k], "context").withColumn("own", (F.col("c") - cut) / F.col("total"))
            if k == 1:
                base = 1.0 / (row["kinds"] + 1)
                first = self.gamma[1].first()
                self.unknown = base * (first["gamma"] if first else 1.0)
                p = met.select("gram", (F.col("own") + F.col("gamma") * base).alias("p"))
            else:
                lower = self.p[k - 1].select(F.col("gram").alias("low"), F.col("p").alias("q"))
                p = met.withColumn("low", F.col("gram").bitwiseAND(_mask(k - 1))).join(lower, "low").select("gram", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"))
            self.p[k] = settle(p)

    def look_up(self, wanted: DataFrame) -> DataFrame:
        """(gram, logp): natural logarithms for the 4-grams of `wanted`, seen or not."""
        rows = wanted.select("gram")
        chance = F.lit(self.unknown)
        for k in range(1, ORDER + 1):
            own = F.col("gram").bitwiseAND(_mask(k)) if k < ORDER else F.col("gram")
            rows = rows.withColumns({f"g{k}": own, f"x{k}": F.shiftrightunsigned(own, 16)})
            rows = rows.join(self.p[k].select(F.col("gram").alias(f"g{k}"), F.col("p").alias(f"p{k}")), f"g{k}", "left")
            if k > 1:
                rows = rows.join(self.gamma[k].select(F.col("context").alias(f"x{k}"), F.col("gamma").alias(f"y{k}")), f"x{k}", "left")
                chance = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"y{k}"), F.lit(1.0)) * chance)
            else:
                chance = F.coalesce(F.col("p1"), chance)
        return rows.select("gram", F.log(chance).alias("logp"))


def trusted_texts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(block, text, mark) of all documents with an id of `trusted` (t_id), and the sum of the marks.

    Only ids are shuffled: they leave a bit for each row of `docs`, 64 rows in one row of 16 bytes that is sent to
    all tasks, and the texts are read where they lie. Marks are hashes of the ids; their sum shows whether a row had
    the same number both times.
    """
    mark = F.pmod(F.xxhash64(id_col), F.lit(1 << 31)).alias("mark")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), mark, F.col(text_col).cast("binary").alias("text"))
    word, bit = F.shiftright("row", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("row", F.lit(64)).cast("int"))
    met = rows.select("row", "id", "mark").join(trusted, F.col("id") == F.col("t_id"), "left_semi")
    bits = settle(met.groupBy(word).agg(F.bit_or(bit).alias("bits"), F.sum("mark").alias("marks")))
    total = bits.agg(F.sum("marks")).first()[0] or 0
    chosen = rows.select("row", word, "mark", "text").join(F.broadcast(bits.select("word", "bits")), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    return chosen.select(F.floor(F.col("row") / BLOCK).cast("long").alias("block"), "text", "mark"), total


def perplexities(docs: DataFrame, model: Model, id_col: str, text_col: str, keep: list[str], block: int = BLOCK) -> DataFrame:
    """(id, `keep`, n_units, perplexity), a row for each row of `docs`; an empty text has its end symbol."""
    place = F.floor(F.monotonically_increasing_id() / block).cast("long").alias("block")
    placed = docs.select(place, F.col(text_col).cast("binary").alias("text"), F.struct(F.col(id_col).alias("id"), *keep).alias("row"))
    shards = max(16, docs.count() // block + 1)

    def ask(batches):
        for now, (texts,) in _in_blocks(batches, 1):
            keys, cut = _by_shard(texts, shards)
            cells = [blobs.put(blobs.gaps(keys[a:b])) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([now] * shards, pa.int64()), pa.array(range(shards), pa.int32()), pa.array(cells, pa.binary())], names=["block", "shard", "asked"])

    asked = placed.select("block", "text").mapInArrow(ask, "block long, shard int, asked binary")

    def merge(key, table):
        keys = np.unique(np.concatenate([blobs.sums(blobs.get(c.as_py())[0]) for c in table.column("asked")]))
        return pa.table({"shard": pa.array([key[0].as_py()] * len(keys), pa.int32()), "gram": pa.array(keys.view(np.int64))})

    wanted = settle(asked.groupBy("shard").applyInArrow(merge, "shard int, gram long"))
    known = settle(wanted.join(model.look_up(wanted), "gram"))

    def answer(key, asked, known):
        grams_, logp = (known.column(n).to_numpy() for n in ("gram", "logp"))
        keys = grams_.view(np.uint64)
        order = np.argsort(keys)
        keys, logp = keys[order], logp[order].astype("<f4")
        cells = [blobs.put(logp[np.searchsorted(keys, blobs.sums(blobs.get(c.as_py())[0]))]) for c in asked.column("asked")]
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "answers": pa.array(cells, pa.binary())})

    answers = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "block long, shard int, answers binary")

    def add_up(key, texts, answers):
        import pandas as pd

        order = np.argsort(answers.column("shard").to_numpy())
        logp = np.concatenate([blobs.get(answers.column("answers")[int(k)].as_py())[0] for k in order]).astype(np.float64)
        raw = texts.column("text").to_pylist()
        keys, _ = _by_shard(raw, shards)
        if len(keys) != len(logp):
            raise RuntimeError("a block holds other texts than when it asked: give a table that reads the same each time")
        order = np.argsort(keys)
        keys, logp, total, n = keys[order], logp[order], np.zeros(len(raw)), np.zeros(len(raw), np.int64)
        for some, where, sizes in grams(raw):
            codes, kinds = pd.factorize(some)
            each = logp[np.searchsorted(keys, kinds)][codes]
            np.add.at(total, where, np.add.reduceat(each, np.cumsum([0, *sizes[:-1]])))
            np.add.at(n, where, sizes)
        return pa.table({"row": texts.column("row"), "n_units": pa.array(n), "perplexity": pa.array(np.exp(-total / np.maximum(n, 1)))})

    row = placed.schema["row"].dataType.simpleString()
    scored = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, f"row {row}, n_units long, perplexity double")
    return scored.select(F.col("row.id").alias(id_col), *[f"row.{c}" for c in keep], "n_units", "perplexity")


def quality_classifier(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = QUANTILE, margin: float = MARGIN, min_units: int = MIN_UNITS,
) -> DataFrame:
    """(id, lang, n_units, perplexity, limit, kept), a row for each row of `docs`.

    `labels` has (id, quality, toxic); rows with quality 1 that are not toxic are trusted. A language
    without trusted documents has no limit (null), and its documents are kept, as are texts of fewer than
    `min_units` units, whose perplexity says little. Null texts are empty.
    """
    trusted = settle(labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).alias("t_id")).where("t_id is not null").distinct())
    fit, marks = trusted_texts(docs, trusted, id_col, text_col)
    model = Model(count_grams(fit))
    if (model.counts.agg(F.sum("mark")).first()[0] or 0) != marks:
        raise RuntimeError("rows have other numbers than when the trusted ones were marked: give a table that reads the same each time")
    scored = settle(perplexities(docs, model, id_col, text_col, [lang_col]))
    good = scored.join(trusted, scored[id_col] == trusted["t_id"], "left_semi")
    limits = good.groupBy(F.col(lang_col).alias("l_lang")).agg((F.percentile_approx("perplexity", quantile, 10_000) * margin).alias("limit"))
    limits = settle(limits)
    met = scored.join(limits, scored[lang_col].eqNullSafe(limits["l_lang"]), "left").drop("l_lang")
    return met.withColumn("kept", F.coalesce((F.col("perplexity") <= F.col("limit")) | (F.col("n_units") < min_units), F.lit(True)))


def op6_quality_classifier(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_classifier(docs, labels)
