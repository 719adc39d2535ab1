"""A hierarchical Pitman-Yor language model over words, trained and applied as Spark jobs.

Every word, and the start of a text, is a context with a restaurant of its own. Its tables are customers of
the one parent restaurant, which all contexts share. The parent's base is uniform over the training words
and one unknown.

Texts go through in blocks of `BLOCK` rows. A block sends the counts of its distinct (word, context)
pairs to shards by hash of the word, a message for each shard. A shard merges them; so a word's
tables in all contexts and in the parent meet in one place. Words of at least `SHARE` of the training
tokens (at most 2 / SHARE words) lie in all shards, by hash of the pair. Seating is sampled in the shards
by Gibbs: customers of a pair leave and come back one after the other (from `PARTY` on in parties), given
the parent's current prediction; then the parent is seated again. A pair of one customer has one table.
What a shard cannot see are totals of the job before: tables of a context over all words come in notes
from the shard of the context's own hash, those of frequent words and the parent's sums through the driver,
at most 2 / SHARE numbers, whatever the corpus.
What the samples kept say of pairs, words and contexts goes back to the blocks, where predictions are
averaged and added up by text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.llm import blobs
from supplyscope.plans.shared import settle

SHARE, BLOCK, BURN_IN, SAMPLES, PARTY, SEED = 1 / 4096, 2048, 2, 3, 64, 7
STRENGTH, PARENT_STRENGTH = 1.0, 10.0
END, START = np.uint64(1), np.uint64(2)  # no word: xxh3 of words is moved off them
CONTEXTS = 1 << 14  # places for frequent words; more than 2 / SHARE + 2
STEP = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words (A-Z in lower case), and the end."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in text.lower().split()], np.uint64)
    return np.append(np.where(h < 8, h + np.uint64(8), h), END)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash; ascending hashes have ascending shards."""
    return (((hashes >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


def _among(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The place of each hash in `frequent`, from 1; 0 where it is none of them."""
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return np.where(frequent[at] == hashes, at + 1, 0)


class Pairs:
    """The distinct (word, context) pairs of a block, ascending by shard, then word hash."""

    def __init__(self, ids: list, texts: list[bytes], frequent: np.ndarray, shards: int):
        tokens = [word_hashes(t or b"") for t in texts]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        words = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.hashes, codes = np.unique(words, return_inverse=True)
        codes = codes.reshape(-1).astype(np.int64)
        n = len(self.hashes)
        before = np.roll(codes, 1)
        before[np.cumsum(self.sizes) - self.sizes] = n  # the start comes after all words
        pairs, inverse = np.unique(codes * (n + 1) + before, return_inverse=True)
        word, context = pairs // (n + 1), pairs % (n + 1)
        self.place = _among(self.hashes, frequent)
        shard, names = shard_of(self.hashes, shards)[word], np.append(self.hashes, START)
        wide = self.place[word] > 0
        shard[wide] = shard_of((names[word[wide]] ^ names[context[wide]] * STEP) * STEP, shards)
        order = np.argsort(shard, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.inverse, self.word, self.context = rank[inverse.reshape(-1)], word[order], context[order]
        self.held = [held_out(i) for i in ids]
        train = np.repeat([not h for h in self.held], self.sizes).astype(bool)
        self.counts = np.bincount(self.inverse[train], minlength=len(pairs))
        self.cuts = np.searchsorted(shard[order], np.arange(shards + 1))

    def cells(self, frequent: np.ndarray) -> list[bytes]:
        """A message for each shard: contexts by their place in `frequent`, others by their hash."""
        names = np.append(self.hashes, START)
        words, contexts, places = names[self.word], names[self.context], _among(names, frequent)[self.context].astype("<u2")
        parts = [slice(a, b) for a, b in zip(self.cuts, self.cuts[1:])]
        return [blobs.put(blobs.gaps(words[p]), places[p], self.counts[p].astype("<u4"), contexts[p][places[p] == 0]) for p in parts]


def _blocks(batches):
    """(block, ids, texts) of rows (block, id, text) that follow each other."""
    now, ids, texts = None, [], []
    for batch in batches:
        for block, one, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if block != now and ids:
                yield now, ids, texts
                ids, texts = [], []
            now = block
            ids.append(one)
            texts.append(text)
    if ids:
        yield now, ids, texts


def _requests(docs: DataFrame, frequent: np.ndarray, shards: int) -> DataFrame:
    """(block, shard, pairs): a block's counts for a shard."""

    def run(batches):
        schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("pairs", pa.binary())])
        for block, ids, texts in _blocks(batches):
            cells = Pairs(ids, texts, frequent, shards).cells(frequent)
            yield pa.RecordBatch.from_arrays([pa.array([block] * shards, pa.int64()), pa.array(range(shards), pa.int32()), pa.array(cells, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "block long, shard int, pairs binary")


def _merge(table: pa.Table, frequent: np.ndarray):
    """Blocks, each block's places in the merged pairs, word hashes, and of each merged pair (word, context hash, count)."""
    order = np.argsort(table.column("block").to_numpy())
    blocks, cells = table.column("block").to_numpy()[order], table.column("pairs")
    parts = [blobs.get(cells[int(k)].as_py()) for k in order]
    contexts = []
    for _, places, _, others in parts:
        own = frequent[np.maximum(places.astype(np.int64) - 1, 0)]
        own[places == 0] = others
        contexts.append(own)
    hashes, codes = np.unique(np.concatenate([blobs.sums(p[0]) for p in parts]), return_inverse=True)
    names, behind = np.unique(np.concatenate(contexts), return_inverse=True)
    n = max(len(names), 1)
    pairs, inverse = np.unique(codes.reshape(-1).astype(np.int64) * n + behind.reshape(-1), return_inverse=True)
    counts = np.bincount(inverse.reshape(-1), np.concatenate([p[2] for p in parts]), len(pairs)).astype(np.int64)
    at = np.cumsum([0] + [len(p[0]) for p in parts])
    places = [inverse.reshape(-1)[a:b] for a, b in zip(at, at[1:])]
    return blocks, places, hashes, pairs // n, names[pairs % n], counts


def frequent_words(docs: DataFrame, share: float) -> np.ndarray:
    """Hashes of all words with at least `share` of the training tokens, some down to half of it, and the start; ascending.

    They only say which words lie in many shards and whose totals pass through the driver. A block names its words
    with at least half the share of its own tokens: what it keeps back of a word is less than half the share in all.
    """

    def run(batches):
        for _, ids, texts in _blocks(batches):
            tokens = [word_hashes(t or b"") for one, t in zip(ids, texts) if not held_out(one)]
            words = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            hashes, counts = np.unique(words, return_counts=True)
            some = counts >= share / 2 * len(words)
            columns = [np.append(hashes[some], np.uint64(0)).view(np.int64), np.append(counts[some], len(words))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["hash", "n"])

    named = settle(docs.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    total = named.where("hash = 0").first()  # no word has hash 0
    found = named.where((F.col("hash") != 0) & (F.col("n") >= share / 2 * total["n"])).collect() if total else []  # at most 2 / share rows
    return np.unique(np.array([r["hash"] for r in found] + [int(START)], np.int64).view(np.uint64))


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables that `customers` of one dish open, each new table with the given weight.

    With j seated at t tables the next one opens a table with probability weight / (weight + j - discount t).
    From `PARTY` seated on, j / 8 customers come in at once and all see the same j and t.
    """
    order = np.argsort(-customers, kind="stable")
    left, w = customers[order], weight[order]
    tables, j = np.minimum(left, 1), 1
    while k := int(np.searchsorted(-left, -j, "left")):
        party = 1 if j < PARTY else j // 8
        odds = w[:k] / (w[:k] + np.maximum(j - discount * tables[:k], 1e-9))
        tables[:k] += rng.random(k) < odds if party == 1 else rng.binomial(np.minimum(party, left[:k] - j), odds)
        j += party
    out = np.empty_like(tables)
    out[order] = tables
    return out


STATE = "shard int, name string, place int, n long, state binary"


def _rows(shard: int, state: bytes, totals: dict[str, np.ndarray], notes: list[tuple[int, str, bytes]] = ()) -> pa.Table:
    """One row with the state, one for each total that is not zero, and the notes to other shards."""
    shards, names, places, values, cells = [shard], [None], [0], [0], [state]
    for name, vector in totals.items():
        some = np.flatnonzero(vector)
        shards += [shard] * len(some)
        names += [name] * len(some)
        places += some.tolist()
        values += vector[some].astype(np.int64).tolist()
        cells += [None] * len(some)
    for to, name, cell in notes:
        shards.append(to)
        names.append(name)
        places.append(shard)
        values.append(0)
        cells.append(cell)
    types = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip((shards, names, places, values, cells), types)], names=["shard", "name", "place", "n", "state"])


def _notes(name: str, contexts: np.ndarray, shards: int, *values: np.ndarray) -> list[tuple[int, str, bytes]]:
    """Notes (shard, name, cell) about contexts, which ascend, to the shards of their hashes."""
    cuts = np.searchsorted(shard_of(contexts, shards), np.arange(shards + 1))
    return [(to, name, blobs.put(blobs.gaps(contexts[a:b]), *[v[a:b] for v in values])) for to, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _vectors(settled: DataFrame) -> dict[str, np.ndarray]:
    """Totals over all shards: as many numbers for each name as there are frequent words, at most."""
    out: dict[str, np.ndarray] = {}
    rows = settled.where("name is not null and state is null").groupBy("name", "place").agg(F.sum("n").alias("n"))
    for r in rows.collect():
        out.setdefault(r["name"], np.zeros(CONTEXTS, np.int64))[r["place"]] = r["n"]
    return out


def _sum_by(places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values by place, from 1; place 0 is left out."""
    some = places > 0
    return np.bincount(places[some] - 1, values[some], CONTEXTS)


def _learner(frequent: np.ndarray, shards: int):
    def learn(key, table):
        blocks, places, hashes, word, context, counts = _merge(table, frequent)
        parent = np.bincount(word, counts > 0, len(hashes)).astype(np.int64)
        total, wide, own = np.bincount(word, counts, len(hashes)), _among(hashes, frequent), _among(context, frequent)
        one = lambda x: np.array([x])
        few = parent[wide == 0]
        totals = {
            "tables": _sum_by(own, counts > 0), "wide total": _sum_by(wide, total), "wide parent": _sum_by(wide, parent),
            "tokens": one(counts.sum()), "texts": one(counts[hashes[word] == END].sum()), "words": one((total[wide == 0] > 0).sum()), "parent": one(few.sum()),
            "pairs of one": one((counts == 1).sum()), "pairs of two": one((counts == 2).sum()),
            "parent of one": one((few == 1).sum()), "parent of two": one((few == 2).sum()),
        }
        met = (own == 0) & (counts > 0)
        names, codes = np.unique(context[met], return_inverse=True)
        needed = np.bincount(codes.reshape(-1), counts[met] > 1, len(names)) > 0
        notes = _notes("ask", names, shards, np.bincount(codes.reshape(-1), minlength=len(names)).astype("<u4"), needed.astype("<u1"))
        state = blobs.put(
            blocks.astype("<i8"), np.array([len(p) for p in places], "<i8"), blobs.gaps(np.concatenate(places).astype("<i8")),
            blobs.gaps(hashes), blobs.gaps(word.astype("<u4")), counts.astype("<u4"), context[counts > 1],
        )
        return _rows(int(key[0].as_py()), state, totals, notes)

    return learn


def _tell(key, table):
    """Tables of each context of a shard over all words (a row "own"), and what the shards that asked need of them."""
    me = int(key[0].as_py())
    asked = [(int(p), blobs.get(c)) for p, c in zip(table.column("place").to_pylist(), table.column("state").to_pylist())]
    contexts = [blobs.sums(a[0]) for _, a in asked]
    names, codes = np.unique(np.concatenate(contexts), return_inverse=True)
    tables = np.bincount(codes.reshape(-1), np.concatenate([a[1] for _, a in asked]), len(names)).astype("<u4")
    rows = [(me, "own", me, blobs.put(blobs.gaps(names), tables))]
    for (asker, (_, _, needed)), some in zip(asked, contexts):
        if needed.any():
            rows.append((asker, "told", me, blobs.put(tables[np.searchsorted(names, some[needed > 0])])))
    shard, name, place, cell = zip(*rows)
    types = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip((shard, name, place, [0] * len(rows), cell), types)], names=["shard", "name", "place", "n", "state"])


def _discount(one: int, two: int) -> float:
    return float(np.clip(one / max(1, one + 2 * two), 0.1, 0.95))


def _predicted(parent, tables, sums, total_tables, base, d0):
    return (parent - d0 * tables + (PARENT_STRENGTH + d0 * total_tables) * base) / (PARENT_STRENGTH + sums)


def pitman_yor_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of `docs`.

    Null texts are empty and have one token, the end; a null id counts as an empty text. Repeated rows
    count as often as they come. Without training rows every word is the unknown one.
    """
    rows = docs.count()
    place = F.floor(F.monotonically_increasing_id() / block).cast("long").alias("block")
    placed = docs.select(place, F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    shards = max(16, 2 * (rows // block + 1))
    frequent = frequent_words(placed, share)
    learned = settle(_requests(placed, frequent, shards).groupBy("shard").applyInArrow(_learner(frequent, shards), STATE))
    first = _vectors(learned)
    number = lambda of, name: int(of[name][0]) if name in of else 0
    zero = np.zeros(CONTEXTS, np.int64)
    tables_before, wide_total, wide_parent = (first.get(n, zero) for n in ("tables", "wide total", "wide parent"))
    n_train, n_texts, n_words = number(first, "tokens"), number(first, "texts"), number(first, "words") + int((wide_total > 0).sum())
    one, two = (number(first, f"parent of {n}") + int((wide_parent == k).sum()) for n, k in (("one", 1), ("two", 2)))
    d1, d0 = _discount(number(first, "pairs of one"), number(first, "pairs of two")), _discount(one, two)
    base, parent_before = 1.0 / (n_words + 1), number(first, "parent") + int(wide_parent.sum())
    told = settle(learned.where("name = 'ask'").groupBy("shard").applyInArrow(_tell, STATE))

    def sample(key, states, answers):
        shard = int(key[0].as_py())
        blocks, sizes, steps, names, words, counts, context = blobs.get(states.column("state")[0].as_py())
        hashes, word = blobs.sums(names), blobs.sums(words).astype(np.int64)
        rng, own, n = np.random.default_rng([SEED, shard]), counts > 1, len(hashes)
        w, c, p = word[own], counts[own].astype(np.int64), _among(context, frequent)
        rare = np.unique(context[p == 0])
        order = np.argsort(answers.column("place").to_numpy())
        known = np.concatenate([np.zeros(0, np.int64), *[blobs.get(answers.column("state")[int(k)].as_py())[0] for k in order]]).astype(np.int64)
        at = np.searchsorted(rare, context[p == 0])
        before = tables_before[np.maximum(p - 1, 0)]
        before[p == 0] = known[at]
        fixed, wide = np.bincount(word[counts == 1], minlength=n), _among(hashes, frequent)
        # tables of a frequent word in other shards
        others = np.where(wide > 0, wide_parent[np.maximum(wide - 1, 0)] - np.bincount(word, counts > 0, n).astype(np.int64), 0)
        tables = np.ones(len(c), np.int64)
        parent = others + fixed + np.bincount(w, tables, n).astype(np.int64)
        parent_tables, kept, more, totals = np.minimum(parent, 1), [], [], {}
        for sweep in range(BURN_IN + SAMPLES):
            now = _predicted(parent, parent_tables, parent_before, n_words, base, d0)
            tables = seat(c, (STRENGTH + d1 * before) * now[w], d1, rng)
            parent = others + fixed + np.bincount(w, tables, n).astype(np.int64)
            weight = np.full(n, (PARENT_STRENGTH + d0 * n_words) * base)
            parent_tables = seat(parent, weight, d0, rng)
            if sweep >= BURN_IN:
                s = len(more)
                kept += [tables.astype("<u4"), parent_tables.astype("<u4")]
                more.append(np.bincount(at, (tables - 1)[p == 0], len(rare)).astype("<u4"))
                totals[f"tables {s}"] = _sum_by(p, tables - 1)
                totals[f"wide parent {s}"] = _sum_by(wide, parent - others)
                totals[f"parent {s}"] = np.array([parent[wide == 0].sum()])
                totals[f"parent tables {s}"] = np.array([parent_tables[wide == 0].sum()])
        some = np.sum(more, axis=0) > 0
        notes = _notes("more", rare[some], shards, *[m[some] for m in more])
        return _rows(shard, blobs.put(blocks, sizes, steps, names, words, counts, *kept), totals, notes)

    states = learned.where("name is null").select("shard", "state").groupBy("shard")
    replies = told.where("name = 'told'").select("shard", "place", "state").groupBy("shard")
    sampled = settle(states.cogroup(replies).applyInArrow(sample, STATE))
    then, rng, seen = _vectors(sampled), np.random.default_rng([SEED, shards]), []
    for s in range(SAMPLES):
        wide_now = then.get(f"wide parent {s}", zero)
        wide_tables = seat(wide_now, np.full(CONTEXTS, (PARENT_STRENGTH + d0 * n_words) * base), d0, rng)
        sums, total_tables = number(then, f"parent {s}") + wide_now.sum(), number(then, f"parent tables {s}") + wide_tables.sum()
        low = _predicted(wide_now, wide_tables, sums, total_tables, base, d0)
        seen.append((sums, total_tables, low, tables_before + then.get(f"tables {s}", zero)))

    def answer(key, rows):
        notes: dict = {}
        for name, cell in zip(rows.column("name").to_pylist(), rows.column("state").to_pylist()):
            notes.setdefault(name, []).append(blobs.get(cell))
        shard, (blocks, sizes, steps, names, words, counts, *kept) = key[0].as_py(), notes[None][0]
        hashes, word = blobs.sums(names), blobs.sums(words).astype(np.int64)
        n, own = len(hashes), counts > 1
        total, fixed, rare = np.bincount(word, counts, n), np.bincount(word[counts == 1], minlength=n), _among(hashes, frequent) == 0
        # tables of this shard's words as contexts
        opened = np.zeros((SAMPLES, n), np.int64)
        for contexts, *tables in [(a, *[b] * SAMPLES) for a, b in notes.get("own", [])] + notes.get("more", []):
            contexts = blobs.sums(contexts)
            at = np.minimum(np.searchsorted(hashes, contexts), n - 1)
            hit = hashes[at] == contexts if n else np.zeros(len(contexts), bool)
            for s, t in enumerate(tables):
                np.add.at(opened[s], at[hit], t[hit])
        gain, low = np.where(counts == 1, 1 - d1, 0.0), []
        for s, (sums, total_tables, _, _) in enumerate(seen):
            tables = kept[2 * s].astype(np.int64)
            gain[own] += np.maximum(counts[own] - d1 * tables, 0) / SAMPLES
            low.append(_predicted(fixed + np.bincount(word[own], tables, n), kept[2 * s + 1], sums, total_tables, base, d0).astype("<f4"))
        at, gain, cells = blobs.sums(steps), gain.astype("<f4"), []
        for b, m in zip(np.cumsum(sizes), sizes):
            mine = at[b - m : b]
            w = np.unique(word[mine])
            w = w[rare[w]]
            cells.append(blobs.put(gain[mine], total[w].astype("<u4"), *[x[w] for x in low], *[x[w].astype("<u4") for x in opened]))
        return pa.table([pa.array(blocks, pa.int64()), pa.array([shard] * len(blocks), pa.int32()), pa.array(cells, pa.binary())], names=["block", "shard", "answers"])

    parts = [told.where("name = 'own'"), sampled.where("name = 'more'"), sampled.where("name is null")]
    parts = [x.select("shard", "name", "state") for x in parts]
    answers = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("shard").applyInArrow(answer, "block long, shard int, answers binary")
    kind = docs.schema[id_col].dataType.simpleString()

    def add_up(key, texts, answers):
        order = np.argsort(answers.column("shard").to_numpy())
        cells = [blobs.get(answers.column("answers")[int(k)].as_py()) for k in order]
        gain, *by_word = (np.concatenate(c).astype(np.float64) for c in zip(*cells))
        ids = texts.column("id").to_pylist()
        own = Pairs(ids, texts.column("text").to_pylist(), frequent, shards)
        rare = own.place == 0
        if len(gain) != len(own.counts) or len(by_word[0]) != rare.sum():
            raise RuntimeError("a block holds other texts than when its pairs were counted: give a table that reads the same each time")
        # of each word, and of the start behind them: count, then for each sample its chance in the parent and its tables as a context
        start, wide = _among(np.array([START]), frequent)[0] - 1, own.place[~rare] - 1
        given = [(wide_total, n_texts), *[(low, 0) for _, _, low, _ in seen], *[(tables, tables[start]) for _, _, _, tables in seen]]
        columns = []
        for mine, (of_wide, of_start) in zip(by_word, given):
            column = np.empty(len(rare) + 1)
            column[:-1][rare], column[:-1][~rare], column[-1] = mine, of_wide[wide], of_start
            columns.append(column)
        total, low, tables = columns[0], columns[1 : 1 + SAMPLES], columns[1 + SAMPLES :]
        # every training token but an end has one token behind it: a word's count is the number of its customers
        back = sum((STRENGTH + d1 * t[own.context]) * x[own.word] for x, t in zip(low, tables)) / SAMPLES
        log = np.log10((gain + back) / (STRENGTH + total[own.context]))
        total = total[own.word]
        start = np.cumsum(own.sizes) - own.sizes
        sums = lambda each: np.add.reduceat(each[own.inverse], start) if len(start) else np.zeros(0)
        plain = np.log10((total + 0.1) / (n_train + 0.1 * (n_words + 1)))
        columns = (ids, own.held, own.sizes, sums((total > 0).astype(np.int64)), np.full(len(ids), n_train), sums(plain), sums(log))
        types = (texts.schema.field("id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, schema)
    return scored.withColumnRenamed("id", id_col)


def op10_pitman_yor(spark, sf_dir):
    return pitman_yor_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
