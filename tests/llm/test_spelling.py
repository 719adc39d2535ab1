"""Spelling variants against a plain program that compares all words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from supplyscope.llm import spelling

DOCS = "doc_id long, text string, word string, n long, key long, length int, form string"


def edits(word, letters):
    for k in range(len(word)):
        yield word[:k] + word[k + 1 :]
        for c in letters:
            yield word[:k] + c + word[k + 1 :]
    for k in range(len(word) + 1):
        for c in letters:
            yield word[:k] + c + word[k:]


def brute(docs, damage):
    count = Counter()
    for one, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if one is None else one}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    letters = sorted({c for w in words for c in w})
    form, near = {}, {}
    for w, n in words.items():
        around = {e for e in edits(w, letters) if e in words and e != w}
        near[w] = len(around)
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, near[w], words.get(form[w])))
    return out


def rows(df):
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made_docs(seed):
    """Few stems with many edits, over a small alphabet, with counts from 1 to hundreds."""
    rng = np.random.default_rng(seed)
    alphabet = list("abé×Ü")
    stems = ["".join(rng.choice(alphabet, rng.integers(7, 11))) for _ in range(8)]
    pool = []
    for stem in stems:
        for _ in range(30):
            w, k = stem, int(rng.integers(0, len(stem)))
            for _ in range(int(rng.integers(0, 3))):
                k = int(rng.integers(0, len(w)))
                w = (w[:k] + w[k + 1 :], w[:k] + str(rng.choice(alphabet)) + w[k + 1 :], w[:k] + str(rng.choice(alphabet)) + w[k:])[rng.integers(0, 3)]
            pool += [w] * int(rng.choice([1, 2, 3, 20, 250]))
    rng.shuffle(pool)
    docs = [(k, " ".join(pool[k::40]).replace("a", "A", 3)) for k in range(40)]
    long = "ab" * 3000
    odd = [(100, None), (101, ""), (102, "1 2 _ \n"), (None, "xyzxyzx xyzxyzy"), (103, f"{long} {long}c {long}"), (104, f"{long}c"), (105, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa"), (105, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa")]
    return docs + odd


@pytest.mark.parametrize("damage,blocks", [(0, 1 << 20), (3, 1 << 20), (3, 7)])
def test_same_as_comparing_all_words(spark, damage, blocks):
    docs = made_docs(5)
    table = spark.createDataFrame([(i, t, "w", 1, 2, 3, "f") for i, t in docs], DOCS)
    assert rows(spelling.spelling_variants(table, damage=damage, max_blocks=blocks)) == brute(docs, damage)


def test_useless_filter_changes_nothing(spark):
    """With a bit or less for each word nearly every edit is a false positive; the exact join removes them."""
    docs = made_docs(6)
    table = spark.createDataFrame([(i, t, "w", 1, 2, 3, "f") for i, t in docs], DOCS)
    assert rows(spelling.spelling_variants(table, bits_per_word=1)) == brute(docs, 0)


def test_roots_follow_forms(spark):
    docs = [(1, "abcdefg " * 2 + "abcdefh " * 20 + "abcdeih " * 200 + "abcjeih " * 2000)]
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {"abcdefg": ("abcdefh", "abcjeih"), "abcdefh": ("abcdeih", "abcjeih"), "abcdeih": ("abcjeih", "abcjeih"), "abcjeih": (None, "abcjeih")}


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []


def test_registered_query(spark):
    from supplyscope.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op13_spelling"](spark, sf)) == brute(docs, 31)
