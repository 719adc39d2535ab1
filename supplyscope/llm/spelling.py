"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

Every word has a 64-bit key: its letters' values times the powers of an odd number. The key of an edited
word follows from the key of the word by one product, so all words of one length make the keys of all
their deletions and replacements as arrays, without making a string. Insertions need no probe: they are the
deletions of the longer word. Of a pair with one letter replaced, the word with the lower letter asks.

The keys are asked of blocked Bloom filters, one shard for each word length, `BITS_PER_WORD` bits a word. What is
broadcast at once is at most `BLOCKS` blocks of 64 bits; a larger vocabulary is asked in several passes over the
blocks. Positives travel as two keys, a place and a letter, however long the words are. They meet the vocabulary
by key, and the edit is made once more on the strings, so that neither a false positive of the filter nor two words
with one key can show.

Null and empty texts have no words; a null id counts as an empty one; repeated rows count as often as they come;
an empty table has no words. Words of any length are whole: lengths from `SHARDS` on share one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplyscope.llm.common import per_text
from supplyscope.plans.shared import Stage, settle

MIN_LENGTH, MIN_COUNT, RATIO, DAMAGE = 7, 2, 10, 31
BITS_PER_WORD, BLOCKS, SHARDS = 16, 2 << 20, 64
TABLE_WORDS, POSITIONS = 200_000, 1 << 14
STEP = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """64 bits spread over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_values() -> np.ndarray:
    """A value for each code point of the word class, all of which are below 256."""
    return scramble(np.arange(1, 257, dtype=np.uint64) * STEP)


def powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), STEP), dtype=np.uint64)])[:n]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, code points) of the words of each length, as matrices of at most `POSITIONS` letters or one word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(1, POSITIONS // length)
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            text = "".join([words[k] for k in some.tolist()])
            yield some, np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(some), length)


def where_in_filter(keys: np.ndarray, first: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits to be set there) of each key in a shard of `blocks` blocks that starts at `first`."""
    mixed = scramble(keys)
    block = ((mixed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)) + np.uint64(first)
    one, six = np.uint64(1), np.uint64(63)
    bits = one << (mixed & six)
    for shift in (6, 12, 18):
        bits = bits | one << (mixed >> np.uint64(shift) & six)
    return block, bits


def count_words(docs: DataFrame, id_col: str, text_col: str, min_length: int, damage: int) -> DataFrame:
    """(word, n): occurrences of each run of letters, A-Z lower-cased, that has `min_length` or more.

    With `damage`, one letter of a run is deleted where `damage` divides the checksum of id and run.
    """
    schema = "word string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        import zlib
        from collections import Counter

        runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)
        seen: Counter = Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Counter(runs.findall((text.as_py() or b"").lower().decode("utf-8", "replace")))
                if damage:
                    start = zlib.crc32(f"{'' if one is None else one}:".encode())
                    for word in [w for w in found if zlib.crc32(w.encode(), start) % damage == 0]:
                        at = zlib.crc32(word.encode(), start) % len(word)
                        n, cut = found.pop(word), word[:at] + word[at + 1 :]
                        if len(cut) >= min_length:
                            seen[cut] += n
                seen.update(found)
                if len(seen) >= TABLE_WORDS:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def with_keys(vocabulary: DataFrame) -> DataFrame:
    """`vocabulary` (word, n) with the key and the length of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = letter_values()
        for batch in batches:
            words = batch.column(0).to_pylist()
            keys, length = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int32)
            for rows, codes in by_length(words):
                keys[rows] = (values[codes] * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)
                length[rows] = codes.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64)), pa.array(length)], names=["word", "n", "key", "length"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, key long, length int")


def shards(vocabulary: DataFrame, bits_per_word: int) -> dict[int, tuple[int, int, np.ndarray]]:
    """For each shard (at most `SHARDS`): first block, number of blocks, code points of its letters."""
    shard = F.least("length", F.lit(SHARDS)).alias("shard")
    sizes = {r["shard"]: r["n"] for r in vocabulary.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).collect()}
    letters = vocabulary.select(shard, F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct()
    used: dict[int, list[int]] = {}
    for r in letters.collect():  # at most SHARDS times the letters of the word class
        if r["letter"]:
            used.setdefault(r["shard"], []).append(ord(r["letter"]))
    out, first = {}, 0
    for k in sorted(sizes):
        blocks = max(1, -(-sizes[k] * bits_per_word // 64))
        out[k] = (first, blocks, np.array(sorted(used[k]), np.int64))
        first += blocks
    return out


def filter_part(vocabulary: DataFrame, plan: dict, low: int, high: int) -> np.ndarray:
    """The filter's blocks from `low` to `high`, made of one row for each block that any word sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            shard = np.minimum(batch.column(1).to_numpy(zero_copy_only=False), SHARDS)
            block, bits = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for k in np.unique(shard).tolist():
                rows = shard == k
                block[rows], bits[rows] = where_in_filter(keys[rows], *plan[k][:2])
            inside = (block >= np.uint64(low)) & (block < np.uint64(high))
            yield pa.RecordBatch.from_arrays([pa.array(block[inside].view(np.int64)), pa.array(bits[inside].view(np.int64))], names=["block", "bits"])

    rows = vocabulary.select("key", "length").mapInArrow(run, "block long, bits long")
    got = rows.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most high - low rows
    blocks = np.zeros(high - low, np.uint64)
    blocks[got["block"].to_numpy() - low] = got["bits"].to_numpy().view(np.uint64)
    return blocks


def probe(vocabulary: DataFrame, plan: dict, low: int, high: int, blocks: np.ndarray) -> DataFrame:
    """(src, dst, at, letter): edits whose key the blocks from `low` to `high` hold; an empty letter is a deletion."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(blocks.tobytes())
    schema = "src long, dst long, at int, letter string"

    def touched(shard: int) -> bool:
        return shard in plan and plan[shard][0] < high and plan[shard][0] + plan[shard][1] > low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, held = letter_values(), np.frombuffer(sent.value, np.uint64)

        def hits(keys: np.ndarray, shard: int) -> np.ndarray:
            block, bits = where_in_filter(keys, *plan[shard][:2])
            inside = block - np.uint64(low)  # below `low` it wraps around to a huge number
            ok = inside < np.uint64(high - low)
            return ok & (held[np.where(ok, inside, np.uint64(0))] & bits == bits)

        def rows(src, dst, at, letter):
            return pa.RecordBatch.from_arrays(
                [pa.array(src.view(np.int64)), pa.array(dst.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(letter, pa.string())],
                names=["src", "dst", "at", "letter"],
            )

        for batch in batches:
            words = batch.column(0).to_pylist()
            for _, codes in by_length(words):
                n, length = codes.shape
                power, value = powers(length), values[codes]
                parts = value * power
                keys = parts.sum(axis=1, dtype=np.uint64)
                if touched(shard := min(length - 1, SHARDS)):
                    ahead = np.zeros((n, length), np.uint64)
                    ahead[:, :-1] = (value[:, 1:] * power[:-1])[:, ::-1].cumsum(axis=1, dtype=np.uint64)[:, ::-1]
                    shorter = parts.cumsum(axis=1, dtype=np.uint64) - parts + ahead
                    # of equal letters in a row the first is deleted: the others give the same word
                    first = np.ones((n, length), bool)
                    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
                    row, at = np.nonzero(hits(shorter, shard) & first)
                    if len(row):
                        yield rows(keys[row], shorter[row, at], at, [""] * len(row))
                if touched(shard := min(length, SHARDS)):
                    letters = plan[shard][2]
                    rest, code = (keys[:, None] - parts).ravel(), codes.ravel()
                    for begin in range(0, n * length, POSITIONS):
                        spot = np.arange(begin, min(begin + POSITIONS, n * length))
                        changed = rest[spot, None] + values[letters] * power[spot % length, None]
                        place, which = np.nonzero(hits(changed, shard) & (letters > code[spot, None]))
                        if len(place):
                            spots = spot[place]
                            yield rows(keys[spots // length], changed[place, which], spots % length, [chr(c) for c in letters[which].tolist()])

    asking = [k for k in plan if touched(k) or touched(k - 1)] + [SHARDS]
    asked = vocabulary.where(F.least("length", F.lit(SHARDS)).isin(asking)).select("word")
    return asked.mapInArrow(run, schema)


def near_words(vocabulary: DataFrame, bits_per_word: int = BITS_PER_WORD, max_blocks: int = BLOCKS) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words of a settled `vocabulary` that are one edit apart, once."""
    plan = shards(vocabulary, bits_per_word)
    end = max((first + blocks for first, blocks, _ in plan.values()), default=0)
    positives = Stage(vocabulary.sparkSession)
    for low in range(0, max(end, 1), max_blocks):
        high = min(low + max_blocks, max(end, 1))
        positives.add(probe(vocabulary, plan, low, high, filter_part(vocabulary, plan, low, high)))
    target = vocabulary.select(F.col("key").alias("dst"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    source = vocabulary.select(F.col("key").alias("src"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    found = positives.all().join(target, "dst").join(source, "src")
    after = F.substr("a", F.col("at") + 2, F.char_length("a"))
    edited = F.concat(F.substr("a", F.lit(1), F.col("at")), F.col("letter"), after)
    return found.where(edited == F.col("b")).select("a", "a_n", "b", "b_n").distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): from each row (word, form), the last word on the way of forms.

    Counts rise by the ratio at each step, so there is no circle, and the steps double in each round.
    """
    state = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = settle(state.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return state


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT, ratio: int = RATIO, damage: int = 0, bits_per_word: int = BITS_PER_WORD, max_blocks: int = BLOCKS,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with `min_count` or more occurrences.

    `form` is the near word with the most occurrences (ties: the smallest) if it has `ratio` times those of the
    word or more, `root` the word reached by following forms, `n_near` the number of near words.
    """
    words = count_words(docs, id_col, text_col, min_length, damage).where(F.col("n") >= min_count)
    vocabulary = settle(with_keys(words))
    pairs = near_words(vocabulary, bits_per_word, max_blocks)
    ways = F.array(
        F.struct(F.col("a").alias("word"), (-F.col("b_n")).alias("less"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), (-F.col("a_n")).alias("less"), F.col("a").alias("near")),
    )
    around = pairs.select(F.explode(ways).alias("w")).select("w.*")
    best = around.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    joined = vocabulary.select("word", "n").join(best, "word", "left")
    strong = -F.col("best.less") >= ratio * F.col("n")
    known = settle(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = follow(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir):
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), damage=DAMAGE)
