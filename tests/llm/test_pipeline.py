import re
from collections import Counter

import corpus_pipeline
from corvane.llm import bpe, mixing
from test_bpe import loaded
from test_simhash import brute, closure

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def stage(spark, name, rows, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int("stupid" in (t or ""))) for i, t, _ in rows], LABELS).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    if name != "BPE":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    return out.collect()


ROWS = [(i, f"line of {i} words that differ {i * i} from all\nshared line of many\nand so it ends {i}", f"s{i % 3}") for i in range(12)]
ROWS += [(20, None, None), (21, "", "s0"), (None, "of null id here only once and again", "s1"), (3, ROWS[3][1], "s0"), (40, ROWS[4][1], "s2"), (5, "another text under an id that stands twice already", "s1")]


def key(rows):
    return Counter((i, t or "") for i, t in rows)


def test_toxicity(spark, tmp_path):
    rows = ROWS + [(100 + i, f"you stupid thing number {i} goes here", "s1") for i in range(40)]
    got = key((r.doc_id, r.text) for r in stage(spark, "toxicity", rows, tmp_path))
    assert got == key((i, t) for i, t, _ in ROWS)


def test_line_dedup(spark, tmp_path):
    got = key((r.doc_id, r.text) for r in stage(spark, "line dedup", ROWS, tmp_path))
    assert got == key((i, "\n".join(x for x in (t or "").split("\n") if x != "shared line of many")) for i, t, _ in ROWS)


def test_near_copies(spark, tmp_path):
    got = key((r.doc_id, r.text) for r in stage(spark, "SimHash near-dedup", ROWS, tmp_path))
    roots = closure([brute(t) for _, t, _ in ROWS])
    want = {}
    for n, (i, t, _) in enumerate(ROWS):
        rank = (i is None, i or 0)
        if roots[n] not in want or rank < want[roots[n]][0]:
            want[roots[n]] = (rank, (i, t))
    assert got == key(x for _, x in want.values())


def test_mixing(spark, tmp_path):
    words = lambda t: len(WORD.findall(t or ""))
    got = stage(spark, "mixing", ROWS, tmp_path)
    docs = spark.createDataFrame([(i, t, s) for i, t, s in ROWS], "doc_id long, text string, source string")
    plan = mixing.assign(docs).collect()
    want = {r.source: r.target for r in plan}
    longest = {s: max(words(t) for _, t, x in ROWS if x == s) for s in want}
    assert all(abs(sum(words(r.text) for r in got if r.source == s) - want[s]) <= longest[s] / 2 + 1 for s in want)
    assert {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, _ in ROWS}
    assert Counter(r.doc_id for r in got) == Counter({i: n for i in {r.doc_id for r in plan} if (n := sum(r.copies for r in plan if r.doc_id == i))})


def test_bpe(spark, tmp_path):
    own = loaded()
    got = Counter((r.doc_id, bytes().join(int(x).to_bytes(4, "little") for x in r.ids)) for r in stage(spark, "BPE", ROWS, tmp_path))
    assert got == Counter((i, own.encode(t or "")) for i, t, _ in ROWS)


def test_stages_take_empty_tables_clashing_columns_and_long_texts(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], LABELS).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, Text string, digest string, _digest string, line string"
    long = "a long text without an end " * 60_000
    rows = [(1, long, "en", "s", len(long), "x", "y", "z", "l"), (2, "short one", None, None, None, None, None, None, None)]
    for name, stage_of in corpus_pipeline.STAGES:
        assert stage_of(spark, spark.createDataFrame([], schema), str(tmp_path)).collect() == [], name
        got = stage_of(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()
        assert {r.doc_id for r in got} <= {1, 2} and (name == "mixing" or len(got) == 2), name


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 100


def test_bpe_decodes(spark, tmp_path):
    own = loaded()
    got = key((r.doc_id, r.decoded) for r in stage(spark, "BPE", ROWS, tmp_path))
    assert got == key((i, own.decode([int.from_bytes(x[j : j + 4], "little") for j in range(0, len(x), 4)])) for i, x in ((i, own.encode(t or "")) for i, t, _ in ROWS))
