"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the mean over its features: the word and its pieces of 3 to 6 letters, all as 64-bit hashes.
Features have an embedding where the counts over all training documents prove that they go with toxic texts: at least `MIN_DOCS`
documents hold them, their share of toxic ones is `LIFT` times that of all, and passes what chance gives the best of all features.
All others are zero, so words that training never saw say nothing. Filters of widths 1 to 3 run over the words, each takes its
largest answer over the whole text, and a logistic layer makes the score.

Every labelled document is read, whole: four fifths (by a hash of the id) train, the rest is held out for judging. Texts stay where they
lie; labels come to them as bits for rows. A first pass counts documents for each feature. A second writes each document down as its words with
features, with at most as many blanks in a row as a filter is wide, which changes no answer. The network is trained on these in shards of about
`SHARD_DOCS` documents, all at once, by Adagrad in numpy; after each round the shards' changes are averaged, embeddings by the steps that
touched them, and the round with the least loss over all documents held out is kept. Scores are moved to the share of
toxic documents among all labelled ones. Each language gets the threshold with the best F1 on the held-out fifth; that is for
`flagged` only, a score never reads language, source, id or label. Calibration and thresholds read the held-out logits in steps of 1 / `GRID`.

Null and empty texts, and texts without words, are a text of one blank word. Texts of any length are scored whole, in
overlapping stretches whose largest answers are joined. Repeated rows get a row each; a null id is never a training row. Labels that
differ for one id count as toxic if any does; null labels are left out. With no toxic or no other labelled document, the score is
the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.llm.blobs import get, put
from supplyscope.plans.shared import Stage, settle

MIN_DOCS, LIFT = 3, 2
DIM, WIDTHS, FILTERS = 16, (1, 2, 3), 16
STEPS, BATCH, RATE, DECAY = 600, 16, 0.05, 1e-5
#: documents and bytes of a shard, about; rounds of averaging at most, and epochs at least
SHARD_DOCS, SHARD_BYTES, ROUNDS, EPOCHS = 20_000, 32 << 20, 5, 3
CHUNK, HELD_FEATURES, PART = 128, 2_000_000, 16_384
GRID = 256
THRESHOLD, MIN_POSITIVE = 0.3, 10
STRETCH, CACHE_WORDS = 50_000, 300_000
WORD = re.compile(r"\w+")
STEP = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, number of the word) of all words: the word itself and its pieces of 3 to 6 letters, ends marked."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    marked = "<" + "><".join(words) + ">"
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner, start = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.arange(len(codes)) - start
    left = np.repeat(sizes, sizes) - inside
    values = scramble((codes + np.uint64(1)) * STEP)
    # the whole word: letters bound to their places
    bound = scramble(values + inside.astype(np.uint64) * STEP)
    hashes, owners = [scramble(np.add.reduceat(bound, np.cumsum(sizes) - sizes))], [np.arange(len(words))]
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, 7):
        moved = np.zeros(len(codes), np.uint64)
        moved[: max(len(codes) - n + 1, 0)] = values[n - 1 :]
        rolled = rolled * STEP + moved
        if n >= 3:
            fits = left >= n
            hashes.append(scramble(rolled[fits] + np.uint64(n)))
            owners.append(owner[fits])
    return np.concatenate(hashes), np.concatenate(owners)


def embed(words: list[str], known: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean embedding of the known features of each word; zero where none is known."""
    out = np.zeros((len(words), vectors.shape[1]), np.float32)
    hashes, owners = features(words)
    if not len(hashes) or not len(known):
        return out
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    found = known[at] == hashes
    at, owners = at[found], owners[found]
    order = np.argsort(owners, kind="stable")
    at, owners = at[order], owners[order]
    which, first, counts = np.unique(owners, return_index=True, return_counts=True)
    if len(which):
        out[which] = np.add.reduceat(vectors[at], first, axis=0) / counts[:, None]
    return out


class Layout:
    """Word sequences behind one another, each followed by blanks so that every start has a full window.

    `ends` says which sequences end their text; in the others no window starts that would reach the blanks.
    """

    def __init__(self, docs: list[np.ndarray], ends: list[bool] | None = None):
        pad = max(WIDTHS)
        sizes = np.array([len(d) + pad for d in docs])
        self.starts = np.cumsum(sizes) - sizes
        self.words = np.zeros(int(sizes.sum()), np.int64)  # word 0 is the blank
        cut = 0 if ends is None else np.where(ends, 0, pad - 1)
        self.last = np.maximum(sizes - pad - cut, 1)  # starts of windows; a text without words has one, all blank
        live = np.zeros(len(self.words), bool)
        for d, s, n in zip(docs, self.starts, self.last):
            self.words[s : s + len(d)] = d
            live[s : s + n] = True
        self.dead = ~live


def answers(x: np.ndarray, filters: list[np.ndarray], bias: list[np.ndarray], dead: np.ndarray) -> list[np.ndarray]:
    """For each width the answer of its filters at every start, very low where no window starts."""
    out = []
    for width, w, b in zip(WIDTHS, filters, bias):
        total = np.tile(b, (len(x), 1)).astype(np.float32)
        for j in range(width):
            total[: len(x) - j] += x[j:] @ w[j]
        total[dead] = -1e9
        out.append(total)
    return out


def surprise(with_toxic: np.ndarray, support: np.ndarray, share: float, tried: int | None = None) -> np.ndarray:
    """How far the share of toxic documents with a feature passes what chance gives the best of all `tried` features (0: it doesn't)."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    rate = with_toxic / np.maximum(support, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        yes = np.where(rate > 0, rate * np.log(rate / share), 0)
        no = np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - share)), 0)
    # Chernoff's bound on the chance of such a rate, against the number of features
    beyond = support * (yes + no) - np.log(max(len(support) if tried is None else tried, 1))
    return np.log1p(np.where(rate > share, np.maximum(beyond, 0), 0))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def compact(words: list[str], number: dict[str, tuple[int, ...]]) -> list[int]:
    """The words of a text as the count of their features and those; more blanks in a row than a filter is wide are left out."""
    out: list[int] = []
    blanks = 0
    for w in words or [""]:
        own = number[w]
        if own:
            out.append(len(own))
            out.extend(own)
            blanks = 0
        elif blanks < max(WIDTHS):
            out.append(0)
            blanks += 1
    return out


class Examples:
    """Documents as `compact` wrote them: each an array of word numbers (0 the blank), and the features of each word."""

    def __init__(self, cells: list[bytes]):
        seen: dict[tuple[int, ...], int] = {(): 0}
        self.docs = []
        for cell in cells:
            flat, at, words = np.frombuffer(cell, "<i4").tolist(), 0, []
            while at < len(flat):
                n = flat[at]
                words.append(seen.setdefault(tuple(flat[at + 1 : at + 1 + n]), len(seen)))
                at += 1 + n
            self.docs.append(np.array(words, np.int64))
        self.place = np.array([f for w in seen for f in w], np.int64)
        sizes = np.array([len(w) for w in seen], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.counts = np.maximum(sizes, 1)

    def spread(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of the words behind one another, and how many each has."""
        sizes = self.first[words + 1] - self.first[words]
        return self.place[np.repeat(self.first[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes

    def vectors(self, words: np.ndarray, table: np.ndarray) -> np.ndarray:
        features_of, sizes = self.spread(words)
        out = np.zeros((len(words), DIM), np.float32)
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(table[features_of], (np.cumsum(sizes) - sizes)[full], axis=0) / self.counts[words[full], None]
        return out

    def forward(self, some: list[int], params: list[np.ndarray]):
        k = len(WIDTHS)
        lay = Layout([self.docs[i] for i in some])
        own, inverse = np.unique(lay.words, return_inverse=True)
        x = self.vectors(own, params[0])[inverse]
        per_width, tops = answers(x, params[1 : 1 + k], params[1 + k : 1 + 2 * k], lay.dead), []
        for a in per_width:
            tops.append(np.stack([s + a[s : s + n].argmax(axis=0) for s, n in zip(lay.starts, lay.last)]))
        raw = np.concatenate([a[t, np.arange(FILTERS)] for a, t in zip(per_width, tops)], axis=1)
        return lay, x, tops, raw

    def logits(self, params: list[np.ndarray]) -> np.ndarray:
        some = range(len(self.docs))
        out = [np.maximum(self.forward(some[low : low + 64], params)[3], 0) @ params[-2] + params[-1] for low in range(0, len(some), 64)]
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def shapes(n_features: int) -> list[tuple[int, ...]]:
    return [(n_features, DIM), *[(w, DIM, FILTERS) for w in WIDTHS], *[(FILTERS,) for _ in WIDTHS], (FILTERS * len(WIDTHS),), (1,)]


def cut_flat(flat: np.ndarray, n_features: int) -> list[np.ndarray]:
    """The network's arrays, embeddings first, from all their numbers behind one another."""
    out, at = [], 0
    for shape in shapes(n_features):
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape).astype(np.float32))
        at += size
    return out


def flat_of(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays]).astype(np.float32)


def first_params(evidence: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Random numbers, and a start from what the counts say for certain: the first dimension, read by the first filter."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.05, (len(evidence), DIM)).astype(np.float32)]
    params += [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    params += [rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), np.full(1, -2, np.float32)]
    params[0][:, 0] = evidence
    params[1][0, :, 0] = np.eye(1, DIM)[0] * 2
    params[-2][0] = 2
    return params


def train(examples: Examples, toxic: np.ndarray, params: list[np.ndarray], squares: list[np.ndarray], epochs: int, seed: int) -> np.ndarray:
    """Trains `params` and `squares` in place; how many steps touched each embedding."""
    rng, k = np.random.default_rng(seed), len(WIDTHS)
    touches = np.zeros(len(params[0]), np.float32)

    def step(p: int, grad: np.ndarray, rows=None) -> None:
        if rows is None:
            squares[p] += grad * grad
            params[p] -= RATE * grad / np.sqrt(squares[p]) + DECAY * params[p]
        else:
            squares[p][rows] += grad * grad
            params[p][rows] -= RATE * grad / np.sqrt(squares[p][rows]) + DECAY * params[p][rows]

    for _ in range(epochs):
        order = rng.permutation(len(toxic))
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH].tolist()
            lay, x, tops, raw = examples.forward(some, params)
            mask = rng.random(raw.shape) < 0.8
            hidden = np.maximum(raw, 0) * mask / 0.8
            slope = ((sigmoid(hidden @ params[-2] + params[-1]) - toxic[some]) / len(some)).astype(np.float32)
            back = slope[:, None] * params[-2] * (raw > 0) * mask / 0.8
            grads, dx = [hidden.T @ slope, slope.sum(keepdims=True)], np.zeros_like(x)
            changes = []
            for n, (width, t) in enumerate(zip(WIDTHS, tops)):
                part, w = back[:, n * FILTERS : (n + 1) * FILTERS], params[1 + n]
                dw = np.zeros_like(w)
                for j in range(width):
                    dw[j] = np.einsum("dfe,df->ef", x[t + j], part)
                    np.add.at(dx, t + j, part[:, :, None] * w[j].T)
                changes += [(1 + n, dw), (1 + k + n, part.sum(axis=0))]
            rows = np.flatnonzero(np.abs(dx).sum(axis=1))
            words = lay.words[rows]
            features_of, sizes = examples.spread(words)
            touched, inverse = np.unique(features_of, return_inverse=True)
            pull = np.zeros((len(touched), DIM), np.float32)
            np.add.at(pull, inverse, np.repeat(dx[rows] / examples.counts[words, None], sizes, axis=0))
            step(0, pull, touched)
            touches[touched] += 1
            for p, g in changes:
                step(p, g)
            step(len(params) - 2, grads[0])
            step(len(params) - 1, grads[1])
    return touches


class Network:
    """Scores texts; words are embedded once for as long as they stay in the table."""

    def __init__(self, arrays: list[np.ndarray]):
        k = len(WIDTHS)
        self.known, self.vectors = arrays[0], arrays[1].reshape(-1, DIM)
        self.filters = [a.reshape(w, DIM, FILTERS) for w, a in zip(WIDTHS, arrays[2 : 2 + k])]
        self.bias, self.weights, self.base = arrays[2 + k : 2 + 2 * k], arrays[-2], float(arrays[-1][0])
        self.forget()

    def forget(self) -> None:
        self.number = {"": 0}
        self.table = np.zeros((1024, DIM), np.float32)

    def learn(self, words: list[str]) -> None:
        new = sorted(set(words) - self.number.keys())
        low, high = len(self.number), len(self.number) + len(new)
        if high > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(high - len(self.table), len(self.table)), DIM), np.float32)])
        self.table[low:high] = embed(new, self.known, self.vectors)
        self.number.update(zip(new, range(low, high)))

    def pooled(self, stretches: list[list[str]], ends: list[bool]) -> np.ndarray:
        """Largest answers of each stretch of words."""
        if len(self.number) > CACHE_WORDS:
            self.forget()
        self.learn([w for s in stretches for w in s])
        lay = Layout([np.fromiter(map(self.number.__getitem__, s), np.int64, len(s)) for s in stretches], ends)
        per_width = answers(self.table[lay.words], self.filters, self.bias, lay.dead)
        return np.concatenate([np.maximum.reduceat(a, lay.starts, axis=0) for a in per_width], axis=1)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out = np.full((len(texts), FILTERS * len(WIDTHS)), -1e9, np.float32)
        waiting: list[list[str]] = []
        owners: list[int] = []
        ends: list[bool] = []
        size, lap = 0, max(WIDTHS) - 1

        def settle_waiting() -> None:
            nonlocal size
            if owners:
                np.maximum.at(out, owners, self.pooled(waiting, ends))
            waiting.clear()
            owners.clear()
            ends.clear()
            size = 0

        for k, text in enumerate(texts):
            words = words_of(text)
            # a stretch ends with the words with which the next one begins: every window is in exactly one
            for low in range(0, max(len(words) - lap, 1), STRETCH - lap):
                part = words[low : low + STRETCH]
                if size + len(part) > STRETCH:
                    settle_waiting()
                waiting.append(part)
                owners.append(k)
                ends.append(low + STRETCH >= len(words))
                size += len(part)
        settle_waiting()
        return np.maximum(out, 0) @ self.weights + self.base


def calibrate(z: np.ndarray, toxic: np.ndarray, weight: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logit with the least weighted loss, drawn towards (1, the prior's shift); `times` says how many texts a row stands for."""
    times = np.ones(len(z)) if times is None else times
    weight = weight * times
    prior = np.log(weight[toxic > 0].sum() + 1e-9) - np.log(weight[toxic == 0].sum() + 1e-9)
    given = np.log(times[toxic > 0].sum() + 1e-9) - np.log(times[toxic == 0].sum() + 1e-9)
    start = np.array([1.0, prior - given])
    ab = start.copy()
    weight = weight * times.sum() / weight.sum()
    for _ in range(50):
        p = sigmoid(ab[0] * z + ab[1])
        design = np.stack([z, np.ones_like(z)], axis=1)
        grad = design.T @ (weight * (p - toxic)) + 4 * (ab - start)
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 4 * np.eye(2)
        ab -= np.clip(np.linalg.solve(hess, grad), -1, 1)
    return max(float(ab[0]), 0.05), float(ab[1])


def best_threshold(score: np.ndarray, toxic: np.ndarray, times: np.ndarray | None = None) -> float:
    """The score from which on a prediction has the best F1, half-way to the next lower score; `times` says how many texts a row stands for."""
    times = np.ones(len(score)) if times is None else times
    order = np.argsort(-score, kind="stable")
    s, hit, n = score[order], np.cumsum((toxic * times)[order]), np.cumsum(times[order])
    f1 = 2 * hit / (n + hit[-1])
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores go together
    at = int(f1.argmax())
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])


def labelled_texts(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, dict, tuple[int, int]]:
    """(order, lang, toxic, held, text) of all labelled documents, how many there are by (held, toxic), and how many labels say 0 and 1.

    Only ids are shuffled: they leave a bit for each row of `docs`, 64 rows in one row that is sent to all tasks, and the texts
    are read where they lie. The sum of `order` over the rows met shows whether a row had the same number both times.
    """
    given = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    marked = settle(given.groupBy("id").agg(F.max("toxic").alias("toxic")).where(allowed))
    shares = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col(id_col).cast("string")).alias("order")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), order, F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    word, bit = F.shiftright("row", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("row", F.lit(64)).cast("int"))
    met = rows.select("row", "doc", "order").join(marked, F.col("doc") == F.col("id"))
    fold = F.pmod("order", F.lit(1 << 31))
    toxic_bit = F.when(F.col("toxic") == 1, bit).otherwise(F.lit(0).cast("long"))
    bits = settle(met.groupBy(word).agg(F.bit_or(bit).alias("bits"), F.bit_or(toxic_bit).alias("toxic_bits"), F.sum(fold).alias("marks")))
    total = bits.agg(F.sum("marks")).first()[0] or 0
    set_in = lambda c: F.col(c).bitwiseAND(bit) != 0
    chosen = rows.select("row", word, "order", "lang", "text").join(F.broadcast(bits.drop("marks")), "word").where(set_in("bits"))
    texts = chosen.select("order", "lang", set_in("toxic_bits").cast("int").alias("toxic"), (F.pmod("order", F.lit(5)) == 4).alias("held"), "text")
    seen = texts.groupBy("held", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(fold).alias("marks")).collect()
    if sum(r["marks"] for r in seen) != total:
        raise RuntimeError("the rows of the documents came in another order the second time")
    return texts, {(r["held"], r["toxic"]): r["n"] for r in seen}, (shares.get(0, 0), shares.get(1, 0))


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(feature, documents, toxic documents) with one row for each feature."""
    hashes, support, bad = (np.concatenate([p[j] for p in parts]) for j in range(3))
    order = np.argsort(hashes)
    hashes, support, bad = hashes[order], support[order], bad[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(support, first), np.add.reduceat(bad, first)


def chunk_counts(texts: list[str | None], toxic: np.ndarray) -> tuple[np.ndarray, ...]:
    """(feature, documents, toxic documents) over some texts."""
    docs = [sorted(set(words_of(t))) for t in texts]
    number = {w: k for k, w in enumerate(sorted({w for d in docs for w in d}))}
    hashes, owners = features(list(number))
    by_word = np.argsort(owners, kind="stable")
    ids, place = np.unique(hashes[by_word], return_inverse=True)
    first = np.searchsorted(owners[by_word], np.arange(len(number) + 1))
    support, bad = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for d, is_toxic in zip(docs, toxic):
        if d:
            own = np.unique(np.concatenate([place[first[number[w]] : first[number[w] + 1]] for w in d]))
            support[own] += 1
            bad[own] += int(is_toxic)
    return ids, support, bad


def count_features(texts: DataFrame) -> DataFrame:
    """(feature, n, bad): in how many documents, and toxic documents, of (toxic, text) each feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts):
            h, n, b = merged(parts)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(b)], names=["feature", "n", "bad"])

        parts, held = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                some = batch.slice(low, CHUNK)
                parts.append(chunk_counts(some.column(1).to_pylist(), some.column(0).to_numpy()))
                held += len(parts[-1][0])
                if held > HELD_FEATURES:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > HELD_FEATURES // 2:
                        yield out(parts)
                        parts, held = [], 0
        if held:
            yield out(parts)

    found = texts.select("toxic", "text").mapInArrow(run, "feature long, n long, bad long")
    return found.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def proved_features(texts: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The features that go with toxic texts, in order, and how surely."""
    counts, seen = Stage(texts.sparkSession).add_counted(count_features(texts).where(F.col("n") >= MIN_DOCS), n=F.count(F.lit(1)))
    tried, least = seen["n"], min(LIFT * share, (1 + share) / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bad = (batch.column(j).to_numpy() for j in (1, 2))
            sure = surprise(bad, n, share, tried)
            keep = np.flatnonzero((sure > 0) & (bad > least * n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(sure[keep])], names=["feature", "evidence"])

    rows = counts.select("feature", "n", "bad").mapInArrow(run, "feature long, evidence double").toArrow()
    known, evidence = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(known)
    return known[order], evidence[order]


def write_examples(texts: DataFrame, known: np.ndarray) -> DataFrame:
    """(order, lang, toxic, held, words): the documents as `compact` writes them."""
    sent = texts.sparkSession.sparkContext.broadcast(put(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features_known, number = get(sent.value)[0], {"": ()}
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                some = batch.slice(low, CHUNK)
                docs = [words_of(t) for t in some.column(4).to_pylist()]
                if len(number) > CACHE_WORDS:
                    number = {"": ()}
                new = sorted({w for d in docs for w in d} - number.keys())
                number.update(dict.fromkeys(new, ()))
                hashes, owners = features(new)
                if len(features_known) and len(hashes):
                    at = np.minimum(np.searchsorted(features_known, hashes), len(features_known) - 1)
                    hit = np.flatnonzero(features_known[at] == hashes)
                    for k, f in sorted(zip(owners[hit].tolist(), at[hit].tolist())):
                        number[new[k]] += (f,)
                cells = [np.array(compact(d, number), "<i4").tobytes() for d in docs]
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(cells, pa.binary())], names=["order", "lang", "toxic", "held", "words"])

    return settle(texts.select("order", "lang", "toxic", "held", "text").mapInArrow(run, "order long, lang string, toxic int, held boolean, words binary"))


def train_round(shards: DataFrame, flat: np.ndarray, n_features: int, epochs: int, seed: int) -> np.ndarray:
    """The network (all numbers, then their sums of squares) after every shard has trained it on its own and the changes are averaged."""
    sent = shards.sparkSession.sparkContext.broadcast(put(flat))
    half = len(flat) // 2

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("order", "words", "toxic"))))
        before = get(sent.value)[0]
        params, squares = cut_flat(before[:half], n_features), cut_flat(before[half:], n_features)
        toxic = np.array([r[2] for r in rows], np.float64)
        touches = train(Examples([r[1] for r in rows]), toxic, params, squares, epochs, seed + table.column("shard")[0].as_py())
        weight = np.concatenate([np.repeat(touches, DIM), np.full(half - n_features * DIM, len(rows), np.float32)])
        weight = np.concatenate([weight, weight]).astype(np.float64)
        change = (np.concatenate([flat_of(params), flat_of(squares)]) - before) * weight
        lows = range(0, len(flat), PART)
        cells = [[a[low : low + PART].tobytes() for low in lows] for a in (change, weight)]
        return pa.table({"part": pa.array(range(len(lows)), pa.int32()), "change": pa.array(cells[0], pa.binary()), "weight": pa.array(cells[1], pa.binary())})

    def add_up(table: pa.Table) -> pa.Table:
        change, weight = (sum(np.frombuffer(c) for c in sorted(table.column(n).to_pylist())) for n in ("change", "weight"))
        mean = np.divide(change, weight, out=np.zeros_like(change), where=weight > 0)
        return pa.table({"part": table.column("part").slice(0, 1), "change": pa.array([mean.tobytes()], pa.binary())})

    trained = shards.groupBy("shard").applyInArrow(run, "part int, change binary, weight binary")
    parts = trained.groupBy("part").applyInArrow(add_up, "part int, change binary").orderBy("part").collect()
    return (flat + np.concatenate([np.frombuffer(r["change"]) for r in parts])).astype(np.float32)


def judge(examples: DataFrame, flat: np.ndarray, n_features: int) -> DataFrame:
    """(lang, toxic, z): the logit of each document."""
    sent = examples.sparkSession.sparkContext.broadcast(put(flat[: len(flat) // 2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = cut_flat(get(sent.value)[0], n_features)
        for batch in batches:
            z = Examples(batch.column(2).to_pylist()).logits(params)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z)], names=["lang", "toxic", "z"])

    return examples.select("lang", "toxic", "words").mapInArrow(run, "lang string, toxic int, z double")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The fitted model; `allowed` says of column `id` which labels may be read."""
    texts, n, labelled = labelled_texts(docs, labels, allowed, id_col, text_col, lang_col)
    share = labelled[1] / sum(labelled) if sum(labelled) else 0.0
    both = [n.get((False, v), 0) + n.get((True, v), 0) for v in (0, 1)]
    if not all(both):
        return {"net": bytes(put()), "slope": 0.0, "shift": 0.0, "share": share, "limit": 0.5, "limits": {}}
    # all train, and all judge, where a part would have one kind only
    splits = all(n.get((False, v), 0) for v in (0, 1))
    inner, outer = (F.col("held") == h if splits else F.lit(True) for h in (False, True))
    judged = outer if all(n.get((True, v), 0) for v in (0, 1)) else F.lit(True)
    n_inner, n_bad = (sum(n.get((False, v), 0) if splits else both[v] for v in kinds) for kinds in ((0, 1), (1,)))
    known, evidence = proved_features(texts.where(inner), n_bad / n_inner)
    examples = write_examples(texts, known)
    size = examples.where(inner).agg(F.sum(F.octet_length("words"))).first()[0]
    shards = max(-(-n_inner // SHARD_DOCS), -(-size // SHARD_BYTES))
    dealt = settle(examples.where(inner).select(F.pmod(F.xxhash64("order"), F.lit(shards)).cast("int").alias("shard"), "order", "toxic", "words"))
    flat = flat_of(first_params(evidence))
    flat = best = np.concatenate([flat, np.full_like(flat, 1e-2)])
    epochs = max(EPOCHS, -(-STEPS * BATCH // n_inner))
    rounds, least = min(ROUNDS, epochs), np.inf
    loss = F.avg(F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("toxic") * F.col("z"))
    for k in range(rounds):
        flat = train_round(dealt, flat, len(known), -(-epochs // rounds), 1000 * k)
        now = judge(examples.where(judged), flat, len(known)).agg(loss).first()[0]
        if now < least:
            best, least = flat, now
    arrays = cut_flat(best[: len(best) // 2], len(known))

    step = F.round(F.greatest(F.least("z", F.lit(40.0)), F.lit(-40.0)) * GRID).cast("int").alias("step")
    counted = settle(judge(examples.where(judged), best, len(known)).groupBy("lang", step, "toxic").agg(F.count(F.lit(1)).alias("n")))
    steps = counted.groupBy("step", "toxic").agg(F.sum("n").alias("n")).orderBy("step", "toxic").toArrow()
    z, y, times = steps.column(0).to_numpy() / GRID, steps.column(1).to_numpy().astype(np.float64), steps.column(2).to_numpy().astype(np.float64)
    rate = float((y * times).sum() / times.sum())
    slope, shift = calibrate(z, y, np.where(y > 0, share / max(rate, 1e-9), (1 - share) / max(1 - rate, 1e-9)), times)

    def limit_of(table: pa.Table) -> pa.Table:
        at, bad, many = (table.column(c).to_numpy().astype(np.float64) for c in ("step", "toxic", "n"))
        fits = (bad * many).sum() >= MIN_POSITIVE and ((1 - bad) * many).sum() >= MIN_POSITIVE
        limits = [best_threshold(sigmoid(slope * at / GRID + shift), bad, many)] if fits else []
        return pa.table({"lang": table.column("lang").slice(0, len(limits)), "own": pa.array(limits, pa.float64())})

    limits = counted.where("lang is not null").groupBy("lang").applyInArrow(limit_of, "lang string, own double").orderBy("lang").collect()
    net = put(*[np.ascontiguousarray(a) for a in (known, *[a.ravel() for a in arrays])])
    limit = best_threshold(sigmoid(slope * z + shift), y, times)
    return {"net": bytes(net), "slope": slope, "shift": shift, "share": share, "limit": limit, "limits": {r["lang"]: r["own"] for r in limits}}


def score_texts(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score), a row for each row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(model["net"])
    slope, shift, share = model["slope"], model["shift"], model["share"]
    names = [id_col, *keep]
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = get(sent.value)
        network = Network(arrays) if arrays else None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                if network is None:
                    score = np.full(some.num_rows, share)
                else:
                    score = sigmoid(slope * network.logits(some.column(len(names)).to_pylist()).astype(np.float64) + shift)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], pa.array(score, pa.float64())], names=[*names, "score"])

    return docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def flagged(score: Column, lang: Column, model: dict) -> Column:
    """Whether a score reaches the threshold of its language; languages without one take the common one."""
    limit = F.lit(model["limit"])
    for name, own in model["limits"].items():
        limit = F.when(lang.eqNullSafe(F.lit(name)), own).otherwise(limit)
    return score >= limit


def not_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


def op12_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), not_held_out(F.col("id")))
    scored = score_texts(docs, model, keep=("lang",))
    held_out = F.coalesce(~not_held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out, "score", predicted, flagged(F.col("score"), F.col("lang"), model).alias("flagged"))
