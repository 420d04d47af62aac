import hashlib
import random
from collections import Counter

import pytest

from corvane.llm import line_dedup
from corvane.llm.cuckoo import Cuckoo

SCHEMA = "doc_id long, text string, n_lines string, Text string"


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute(counted, shown, least):
    docs = Counter(k for t in counted for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in shown:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or docs[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=str)


@pytest.mark.parametrize("broadcast_keys", [0, 1000])
def test_insert_and_delete_are_exact_and_reversible(spark, broadcast_keys):
    draw = random.Random(1)
    lines = ["Common Line", "  common line\t", "ÄB", "äB", "", " ", "rare", "other one", "x" * 5000, "a\rb"]
    rows = [(i, "\n".join(draw.choice(lines) for _ in range(draw.randrange(1, 7)))) for i in range(30)]
    rows += [(None, None), (None, "rare"), (7, ""), (3, rows[3][1]), (3, rows[3][1])]
    first, more = frame(spark, rows[:20]), frame(spark, rows[20:])
    index = line_dedup.LineIndex(spark, min_docs=4, shards=3, salts=2, broadcast_keys=broadcast_keys).insert(first)
    before = result(index.apply(first))
    assert before == brute([t for _, t in rows[:20]], rows[:20], 4)
    index.insert(more)
    assert result(index.apply(frame(spark, rows))) == brute([t for _, t in rows], rows, 4)
    index.delete(more)
    assert result(index.apply(first)) == before
    assert index.delete(first).counts().count() == 0


def test_empty_table(spark):
    index = line_dedup.LineIndex(spark).insert(frame(spark, []))
    assert index.apply(frame(spark, [])).collect() == []
    assert result(index.apply(frame(spark, [(1, "a\nb")]))) == [(1, 2, 0, "a\nb")]


def digests(n, seed):
    return [hashlib.md5(f"{seed} {i}".encode()).digest() for i in range(n)]


@pytest.mark.parametrize("size", [0, 12_000])
def test_cuckoo_removal_hides_no_other_key(size):
    for seed in range(20 if size else 2):
        keys, own = digests(12_000, seed), Cuckoo(size)
        for k in keys:
            own.add(k)
        own = Cuckoo(body=own.body())
        assert own.has(keys).all() and own.crowded == (not size)
        for k in keys[:6000]:
            own.remove(k)
        own = Cuckoo(body=own.body())
        assert own.has(keys[6000:]).all() and own.has(keys[:6000]).mean() < 0.01
        assert Cuckoo(size).has(keys).sum() == 0


def test_many_keys_cross_the_threshold_both_ways(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 40)
    rows = [(i, "\n".join(f"line {j}" for j in range(i % 7, 600, 7))) for i in range(70)]
    more = [(100 + i, "\n".join(f"line {j}" for j in range(600, 1400, 3))) for i in range(10)]
    index = line_dedup.LineIndex(spark, min_docs=10, shards=2)
    index.insert(frame(spark, rows))
    assert index.frequent == 600 and index.shards == 16
    assert result(index.apply(frame(spark, rows))) == brute([t for _, t in rows], rows, 10)
    index.insert(frame(spark, more))
    every = rows + more
    assert index.shards == 32 and result(index.apply(frame(spark, every))) == brute([t for _, t in every], every, 10)
    index.delete(frame(spark, rows[:14]))
    left = every[14:]
    assert result(index.apply(frame(spark, left))) == brute([t for _, t in left], left, 10)
