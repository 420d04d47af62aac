import random

from corvane.llm.suffix_tree import maximal_repeats


def brute(texts, least):
    places = {}
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a + least, len(t) + 1):
                places.setdefault(t[a:b], []).append((i, a))
    out = {}
    for s, at in places.items():
        if len(at) > 1:
            left = {texts[i][a - 1 : a] if a else (i, a) for i, a in at}
            right = {texts[i][a + len(s) : a + len(s) + 1] or (i, a) for i, a in at}
            if len(left) > 1 and len(right) > 1:
                out[s] = sorted(at)
    return out


def test_all_maximal_repeats_with_all_places():
    draw = random.Random(2)
    for letters in (b"ab", b"abc\x00", bytes(range(97, 123))):
        for _ in range(15):
            seed = bytes(draw.choice(letters) for _ in range(30))
            texts = []
            for _ in range(draw.randrange(0, 7)):
                t = bytes(draw.choice(letters) for _ in range(draw.randrange(0, 12)))
                a = draw.randrange(30)
                texts.append(t + seed[a : a + draw.randrange(25)] + t[:3])
            for least in (3, 8):
                got = maximal_repeats(texts, least)
                assert len(got) == len({s for s, _ in got})
                assert {s: sorted(at) for s, at in got} == brute(texts, least)
