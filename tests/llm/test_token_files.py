import json
import random

import pyarrow as pa

from quern.llm import token_files

ODD = ["", " \t\n", "aİb", "İ-", "Ét", "été.", "Straße's", "ΣΑΣ", "ªº µ", "ǅ ŉ ſ", "don't", "x<|endoftext|>y", "naïve--Öl", "́a", "\x1cq\x85", "ﬁ Ⅷ", "日本語 a1b2", None]


def ids_of(texts, path):
    found, sizes = token_files._encoded(pa.array(texts, pa.string()), path)
    ends = sizes.cumsum().tolist()
    return [found[b - n : b].tolist() for b, n in zip(ends, sizes.tolist(), strict=True)]


def test_ids_are_the_librarys_on_odd_texts():
    rng, path = random.Random(1), token_files.default_vocab()
    texts = ODD + ["".join(rng.choice("abcÉéßĲŉªİΣς̈' .,<|19  ÀÖ-–\n") for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    library = token_files._library(path)
    assert ids_of(texts, path) == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_words_are_told_apart_before_they_are_looked_up(monkeypatch):
    asked, learn = [], token_files._learn
    monkeypatch.setattr(token_files, "_learn", lambda words, path: asked.append(len(words)) or learn(words, path))
    texts = ["some words come again and again, " * 50] * 20
    assert len({tuple(x) for x in ids_of(texts, token_files.default_vocab())}) == 1
    assert sum(asked) < 20


def test_vocabularies_that_join_words_get_whole_texts(tmp_path):
    spec = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
                  "vocab": {"a": 2, "b": 3, " ": 4, "a ": 5, "a b": 6}, "merges": [["a", " "], ["a ", "b"]]},
    }
    (tmp_path / "v.json").write_text(json.dumps(spec))
    assert ids_of(["a b", None, "ba"], str(tmp_path / "v.json")) == [[6, 1], [1], [3, 2, 1]]
