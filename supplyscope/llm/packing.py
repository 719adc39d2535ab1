"""Packing by minimum bin slack: token pieces into sequences of a fixed capacity.

A document is cut into full pieces and a remainder, in the pass that makes its tokens. Only how
many pieces have each length matters to the plan, and there are at most `capacity` lengths, so the
histogram fits the driver at any corpus size. The plan takes the longest length left and looks for
the multiset of other lengths that fills the window closest to capacity: a subset-sum over bit sets
(bit s: sum s can be reached), stopped as soon as the rest is reached exactly, with the counts read
back from the stored sets. The window found is used as often as the counts allow, then the search
goes on. Pieces take their places by their rank among the pieces of equal length: their number in
their own task plus the number of such pieces in tasks before it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from unicodedata import normalize

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.plans.shared import settle

CAPACITY, END_ID, CACHE_WORDS = 2048, 1, 400_000
MARKS, LATIN = ".,;:!?", "\u024f"

# fixed values: what a tokenizer file must say for its words to be looked up one by one
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_into_words(config: dict) -> bool:
    """Whether a tokenizer drops white space, never joins over it and takes a run of letters as one piece in any case."""
    first, *more = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = config["model"]
    return (
        (config.get("normalizer") or {}).get("normalizers") == NORMAL
        and first.get("pattern") == {"Regex": SPLIT}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and [(m.get("type"), m.get("add_prefix_space"), m.get("use_regex")) for m in more] == [("ByteLevel", False, False)]
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) and t["content"].startswith("<|") for t in config["added_tokens"])
    )


def byte_letters() -> dict[int, str]:
    """The letter for each byte in a byte-level vocabulary: printable ones stand for themselves, the others for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def in_latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds:
    """Token ids of words as bytes. Words of Latin letters, and those with one mark behind, go to the merges at once; all
    others are encoded like a text of their own."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()
        self.marks = dict(zip(MARKS, self.encode(list(MARKS))))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", got.ids).tobytes() for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters_only(self, word: str) -> bytes | None:
        if not word.isalpha():
            return None
        if word.isascii():
            word = word.lower()
        elif max(word) > LATIN:
            return None
        else:
            word = normalize("NFC", word).lower()
            if not word.isalpha():
                return None
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def learn(self, words: list[str], known: dict[str, bytes]) -> None:
        """Adds the ids of `words` to `known`; a word with a mark behind takes those of the word without it."""
        late = []
        for word in words:
            mark = self.marks.get(word[-1])
            if mark is None or len(word) == 1:
                ids, mark = self.letters_only(word), b""
            else:
                stem = word[:-1]
                ids = known.get(stem)
                if ids is None and (ids := self.letters_only(stem)) is not None:
                    known[stem] = ids
                elif not stem.isalpha():  # its last letters and the mark may be one piece
                    ids = None
            if ids is None:
                late.append(word)
            else:
                known[word] = ids + mark
        known.update(zip(late, self.encode(late)))


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def tokenize_pieces(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """A row for each piece of a document's token ids (the end id included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json
        import os
        import zlib

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        by_word = splits_into_words(json.loads(tokenizer.to_str()))
        lookup = WordIds(tokenizer)
        known: dict[str, bytes] = {"": b""}
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = array("I", [END_ID]).tobytes()

        def learn(words) -> None:
            new = list({w for w in words if w not in known})
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                known[""] = b""
                new = list({w for w in words if w})
            if by_word:
                lookup.learn(new, known)
            else:
                known.update(zip(new, lookup.encode(new)))

        def split(text: str) -> list[str]:
            if not by_word:  # any other tokenizer gets its texts whole
                return [text]
            # control strings are recognised in their own case only; these letters are lowered one by one
            if "<|" not in text and (text.isascii() or in_latin_1(text)):
                text = text.lower()
            return text.replace("\n", " ").split(" ")

        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                some = batch.slice(low, 100)
                texts = [split(t or "") for t in some.column(1).to_pylist()]
                ids, rows = [], []
                for one, words in zip(some.column(0).to_pylist(), texts):
                    for k in range(0, len(words), 100_000):
                        learn(words[k : k + 100_000])
                    try:
                        tokens = b"".join([known[w] for w in words]) + end
                    except KeyError:  # the table was emptied within this long text
                        tokens = bytearray()
                        for k in range(0, len(words), 100_000):
                            learn(words[k : k + 100_000])
                            tokens += b"".join([known[w] for w in words[k : k + 100_000]])
                        tokens = bytes(tokens) + end
                    n = len(tokens) // 4
                    for at in range(0, n, capacity):
                        size = min(capacity, n - at)
                        ids.append(one)
                        rows.append((at, size, zlib.crc32(tokens[4 * at : 4 * (at + size)]), n, part, seen[size]))
                        seen[size] += 1
                columns = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, types))],
                    names=["id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, {PIECE}")


def fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of `lengths` (descending, bounded by `counts`) whose sum comes closest to `room`."""
    reach, steps, mask = 1, [], (2 << room) - 1
    for length in lengths:
        if reach >> room & 1:
            break
        left, times = min(counts[length], room // length), 1
        while left > 0:
            take = min(times, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & mask
            left, times = left - take, times * 2
    total, taken = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            taken[length] = taken.get(length, 0) + take
    return taken


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, copies in a window, first sequence, offset of the first copy)."""
    counts, used, rows, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        rest = sorted((n for n in counts if counts[n] and n <= capacity - largest), reverse=True)
        chosen = fill(counts, rest, capacity - largest)
        counts[largest] += 1
        chosen[largest] = chosen.get(largest, 0) + 1
        times, offset = min(counts[n] // k for n, k in chosen.items()), 0
        for n, k in sorted(chosen.items(), reverse=True):
            rows.append((n, used[n], times * k, k, sequence, offset))
            used[n] += times * k
            counts[n] -= times * k
            offset += n * k
            if not counts[n]:
                del counts[n]
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    Null text is empty: one piece with the end id. Repeated rows are packed as often as they come.
    """
    pieces = settle(tokenize_pieces(docs, tokenizer_file, id_col, text_col, capacity))
    own = settle(pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n")))
    histogram = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    fields = "length long, low long, ranks long, copies long, first long, at long"
    # a window uses up a length or leaves fewer than it takes, so the plan has a few rows for each length
    plan = docs.sparkSession.createDataFrame(plan_windows(histogram, capacity), fields)
    nth = F.col("rank") - F.col("low")
    placed = ranked.join(F.broadcast(plan), "length").where((nth >= 0) & (nth < F.col("ranks")))
    sequence = F.col("first") + F.floor(nth / F.col("copies"))
    offset = F.col("at") + F.pmod(nth, F.col("copies")) * F.col("length")
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def op9_packing(spark, sf_dir, tokenizer_file: str | None = None):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file or public_tokenizers.path("word_bpe_49k.json"))
