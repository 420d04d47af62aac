import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from corvane.llm import bpe

TEXTS = ["", None, " \n\t", "Hello World's it's 'll'RE !!??", "<|endoftext|>É<|startoftext|>é<|endoftext|>", "İΣ ΑΣ ς ǅ ﬁ", "x" * 4000, "ab" * 3000, "中文 のテスト 한국어", "\x1c a\x1fb\x85c​d", "1234567890 ½ ²", "é Å"]


def test_agrees_with_the_library(spark):
    draw = random.Random(4)
    texts = TEXTS + ["".join(draw.choice("abcdefg'st éß1!  \n中") for _ in range(draw.randrange(80))) for _ in range(300)]
    own = Tokenizer.from_file(bpe.tokenizer_file())
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, TEXT string")
    want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert {r.doc_id: r.ids for r in bpe.encode(docs).collect()} == dict(enumerate(want))
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()} == {i: own.decode(x, skip_special_tokens=False) for i, x in enumerate(want)}
    for r in bpe.digests(docs).collect():
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest())
    assert bpe.encode(docs.limit(0)).collect() == []


def loaded():
    with open(bpe.tokenizer_file(), encoding="utf-8") as f:
        body = f.read()
    return bpe.Vocabulary(body, bpe.strange_points(body))


def test_every_code_point():
    own, library = loaded(), Tokenizer.from_file(bpe.tokenizer_file())
    points = [x for x in range(0x110000) if not 0xD800 <= x < 0xE000 and not 0x40000 <= x < 0xE0000]
    for at in range(0, len(points), 5000):
        texts = [f"a{chr(x)}b1 {chr(x)}\u0301 A\u0323{chr(x)}" for x in points[at : at + 5000]]
        want = library.encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(own.encode(x), "<u4").tolist() for x in texts] == [x.ids for x in want]


def test_words_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    own, words = loaded(), [f"word{i}s" for i in range(40)] * 2
    assert len({own.encode(w) for w in words}) == 40 and len(own.young) <= 5
