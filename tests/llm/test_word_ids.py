"""Token ids of single words against the tokenizer on whole texts."""

import json

import pytest

from supplyscope.llm import packing

TEXTS = [
    "Plain words, and more. MIXED Case! it's we'll 'd x's 12 3a a3 ... ,. (a) [b]; c:d e/f",
    "Ünïcode ÀÉ straße ŒUVRE naïve, Ærø. İstanbul ǅungla ſoft ﬁne ΑΣ ΣΑΣ. Привет 你好 ª º",
    "été ärger. Ångstrom 힣 ẞ 😀 😀, x‍y a­b   tab\tnew\nline",
    "<|endoftext|> x<|startoftext|>y <|EndOfText|> |> <| . , ! ?",
    "a, a a. (a (a, 1 1, 1. é É, é. É. x-y x-y, don't. can't, 's. .. ., ,.",
    "", " ", "a", "A.", ".", "..", "é,", "É", "'", "’s don’t",
]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_words_have_the_ids_of_the_text(tokenizer):
    from array import array

    lookup = packing.WordIds(tokenizer)
    latin = ["".join(map(chr, range(k, k + 3))) for k in range(0x41, 0x250)]
    for text in [*TEXTS, " ".join(latin), ", ".join(latin) + "."]:
        words = [w for w in text.replace("\n", " ").split(" ") if w]
        known = {}
        lookup.learn(words, known)
        got = b"".join([known[w] for w in words])
        assert list(array("I", got)) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_tokenizer_files_are_checked(tokenizer):
    config = json.loads(tokenizer.to_str())
    assert packing.splits_into_words(config)
    other = json.loads(json.dumps(config))
    other["normalizer"]["normalizers"].pop()
    assert not packing.splits_into_words(other)
    assert not packing.splits_into_words({**config, "pre_tokenizer": None})
    assert not packing.splits_into_words({**config, "normalizer": None})


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"a": 5, "b": 6, "?": 7}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.Split(" ", "isolated")
    plain.save(str(tmp_path / "t.json"))
    docs = spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id long, text string")
    rows = packing.pack(docs, str(tmp_path / "t.json")).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {1: 6, 2: 1}
