from collections import Counter

from corvane.llm import quality

TEXTS = ["", None, " \n ", "a b c a b c x", "é# ü$\n\né# ü$\né# ü$ ", "w " * 30_000, " ".join(map(str, range(60))), "one two three four five six seven eight nine ten " * 6, "a\x85b c\xa0d"]


def brute(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_and_base_rules(spark):
    docs = spark.createDataFrame([(i, t, "h", "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, host string, n_words string")
    for r in quality.rules(docs).collect():
        want = brute(TEXTS[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_host_verdicts_are_shrunk_and_joined(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "clean") for i in range(40)] + [(100 + i, "bad" if i < 36 else good, "foul") for i in range(40)] + [(200, "bad", "single"), (201, good, None), (201, good, None), (None, good, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ruled = quality.rules(docs)
    rate = {r.host: r for r in quality.hosts(ruled).collect()}
    assert rate["foul"].rejected and not rate["clean"].rejected and not rate[None].rejected
    assert 0 < rate["clean"].rate < 0.1 < rate["single"].rate < 1 and 0.5 < rate["foul"].rate < 0.9
    got = quality.judged(ruled).collect()
    assert len(got) == len(rows) and all(r.kept == (not r.base_failed and r.host != "foul" and not (r.host == "single" and rate["single"].rejected)) for r in got)
    assert quality.judged(quality.rules(docs.limit(0))).collect() == []
