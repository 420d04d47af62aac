import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from corvane.llm import bpe


@pytest.fixture(scope="module")
def body():
    with open(bpe.tokenizer_file(), encoding="utf-8") as f:
        return f.read()


@pytest.fixture
def own(body):
    return bpe.Vocabulary(body, bpe.strange_points(body))


def drawn(seed, n, most, letters="abcdefg'st éß1!  \n中\x1c\x1f\x85 \U0001fae8"):
    draw = random.Random(seed)
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(most))) for _ in range(n)]


def same(own, texts):
    want = Tokenizer.from_file(bpe.tokenizer_file()).encode_batch(texts, add_special_tokens=False)
    got = list(own.encode_all(texts))
    assert len(got) == len(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in want]


def test_words_of_a_text_are_merged_once(own, monkeypatch):
    """A text of more words than are kept, in turns: each was merged anew at each turn, one by one."""
    monkeypatch.setattr(bpe, "KEPT", 100)
    words = sorted({x for x in drawn(1, 3000, 12, "abcdefgh") if x})
    alone, beside = [], []
    one, many = bpe.Vocabulary.merged, getattr(bpe.Vocabulary, "merged_all", None)
    monkeypatch.setattr(bpe.Vocabulary, "merged", lambda self, x: alone.append(1) or one(self, x))
    monkeypatch.setattr(bpe.Vocabulary, "merged_all", lambda self, x: beside.extend(x) or many(self, x), raising=False)
    got = own.encode(" ".join(words * 4))
    assert len(alone) < 100 and len(alone) + len(beside) == len(words)
    assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(bpe.tokenizer_file()).encode(" ".join(words * 4), add_special_tokens=False).ids


@pytest.mark.parametrize("few", [1, 1 << 30])
def test_any_cut_into_slabs_and_stretches(own, monkeypatch, few):
    for name, value in {"KEPT": 7, "SLAB": 5, "STRETCH": 9, "LEAVES": 64, "FEW": few}.items():
        monkeypatch.setattr(bpe, name, value)
    long = " ".join(drawn(2, 60, 30))
    texts = ["", "<|endoftext|>", " <|startoftext|>a b<|endoftext|><|endoftext|> c", "a" * 300, "", "x\x1dy z\x1e", "Á ệ İΣ", "ﷺ" * 9, long, long + "<|endoftext|>" + long, ""]
    same(own, texts + drawn(3, 300, 60) + texts)


def test_words_of_all_lengths(own):
    same(own, [" ".join(drawn(n, 40, n, "aeinorst")) for n in (2, 3, 5, 9, 17, 33, 65, 129, 257)] + drawn(5, 50, 400, "theingé中"))


def test_a_text_longer_than_a_slab_beside_others(own, monkeypatch):
    monkeypatch.setattr(bpe, "SLAB", 1000)
    monkeypatch.setattr(bpe, "STRETCH", 4000)
    same(own, ["a b", " ".join(drawn(6, 4000, 9, "abc,.")), "c d", "\n".join(drawn(7, 4000, 9, "abc,.")), ""])


def test_pieces_kept_stay_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    monkeypatch.setattr(bpe, "SLAB", 20)
    for _ in own.encode_all(drawn(8, 500, 40, "abcdef  ")):
        assert len(own.young) <= 50 and len(own.old) <= 50 + 20 + 40
    own.encode("y" * 500 + " z")
    assert "z" in own.young or "z" in own.old
    assert not any(len(x) > 64 for x in [*own.young, *own.old])
