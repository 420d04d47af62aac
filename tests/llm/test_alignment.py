import hashlib
import random
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import alignment, bpe

A, B = bpe.tokenizer_file("byte_bpe_50k.json"), bpe.tokenizer_file("piece_bpe_32k.model")


def model(texts):
    """Rows by whole-text encoding and byte ranges of all pairs of tokens."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    code = {x: i for i, x in enumerate(bpe.byte_symbols())}
    found = []
    for t in texts:
        ia, ib, links, groups = [], [], [], []
        if t:
            ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            ba = [bytes(code[c] for c in a.id_to_token(i)) for i in ia]
            bb = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
            if not b"".join(ba) == b"".join(bb) == (" " + t).encode():
                ia, ib = [], []
        if ia:
            ends = []
            for tokens in (ba, bb):
                at, row = 0, []
                for x in tokens:
                    row.append((at, at + len(x)))
                    at += len(x)
                ends.append(row)
            links = [(x, y) for x, r in zip(ia, ends[0]) for y, s in zip(ib, ends[1]) if r[0] < s[1] and s[0] < r[1]]
            low = 0
            for cut in sorted({e for _, e in ends[0]} & {e for _, e in ends[1]}):
                groups.append("|".join(",".join(str(i) for i, r in zip(ids, row) if low < r[1] <= cut) for ids, row in zip((ia, ib), ends)))
                low = cut
        found.append((len(ia), len(ib), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    docs = Counter(p for x in found for p in set(x[3]))
    top: dict[int, int] = {}
    for (x, _), n in docs.items():
        top[x] = max(top.get(x, 0), n)
    return [(na, nb, ng, len(ls), sum(docs[p] == top[p[0]] for p in ls), sum(docs[p] for p in ls), h) for na, nb, ng, ls, h in found]


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_matches_byte_ranges(spark):
    draw = random.Random(8)
    words = ["the", "antidisestablishment", "naïve", "日本語", "it's", "<|endoftext|>", "x▁y", "  ", "\n\n", " \n ", "\t", "42.50", "😀", "á", "</s>", "<0x41>", "_", " ", "\u0085", "Ünïcode"]
    texts = [None, "", " ", "  lead", "trail  ", "▁", "\x00 a", "a  b", "the the the"] + [draw.choice(["", " ", "\n"]).join(f"{draw.choice(words)}{draw.choice(['', ' ', ', ', '  ', ' 7'])}" for _ in range(draw.randrange(1, 60))) for _ in range(80)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "the the the", 0), (4, "trail  ", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, DOC_ID int").repartition(3)
    want = model([t for _, t, _ in rows])
    assert rows_of(alignment.alignments(df)) == sorted((-1 if i is None else i, *x) for (i, _, _), x in zip(rows, want))
    assert alignment.alignments(df.limit(0)).collect() == []


def test_long_text_and_small_cache(spark, monkeypatch):
    draw = random.Random(2)
    long = "".join(draw.choice("abcdefghij é") for _ in range(6_000))
    df = spark.createDataFrame([(1, long), (2, "x" * 5000), (3, long[:100])], "doc_id long, text string")
    assert rows_of(alignment.alignments(df)) == sorted((i, *x) for i, x in zip((1, 2, 3), model([long, "x" * 5000, long[:100]])))


def test_transducer_keeps_its_transitions():
    own = alignment.Transducer([b"ab", b"c", b"abc", b"x"], [b"a", b"bc", b"abc", b"xx"])
    w = alignment.WIDTH
    assert own.aligned([0, 1, 2], [0, 1, 2]) == ([0 << w | 0, 0 << w | 1, 1 << w | 1, 2 << w | 2], b"0,1|0,1;2|2")
    steps = dict(own.steps)
    assert own.aligned([0, 1], [0, 1])[1] == b"0,1|0,1" and own.steps == steps
    assert own.aligned([2], [2])[1] == b"2|2" and own.steps == steps
    assert own.aligned([3], [3]) is None and own.aligned([0], [2]) is None and own.aligned([3], [0]) is None and own.aligned([0, 1, 2], [0, 1]) is None


def test_plain_stretches_are_encoded_alike():
    """The faster encoder and the library's agree on all plain code points, beside letters, digits, signs and spaces."""
    own = alignment.aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    points = [chr(x) for x in (9, 10, *range(32, 0x180)) if alignment.PLAIN(chr(x))]
    texts = [f.format(x, y) for x in points for y in "a1' é" for f in (" {0}{1}", " {1}{0}b", " a{0}{1}1{0}", "'{0}{1}{0}  ")] + [" can't we'll I'd they've it's 'tis 're", " 12é3 don'T 'LL"]
    assert own.plain and all(map(alignment.PLAIN, texts))
    assert [own.plain(x) for x in texts] == [x.ids for x in own.a.encode_batch(texts, add_special_tokens=False)]
