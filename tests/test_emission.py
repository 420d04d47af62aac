import hashlib

import pytest

from corvane.operators import chunking, emission
from corvane.sources import resumable

SECTIONS = "doc_id long, section string, chunks array<string>, list array<struct<name:string,desc:string>>, text string"


def corpus(spark):
    long = " ".join(f"Sentence number {i} says little." for i in range(300))
    rows = [(1, "a", ["one.", "two."], [("n", "d"), ("", "only")], "unused"), (1, "b", None, None, long), (2, "a", [], [], "a text"), (3, "a", None, None, " "), (4, "a", None, None, None)]
    titles = [(1, "T", "", "x"), (2, " P ", "R", "")]
    return spark.createDataFrame(rows, SECTIONS), spark.createDataFrame(titles, "doc_id long, title string, retrieval_title string, kind string")


def test_units_are_paragraphs(spark):
    sections, _ = corpus(spark)
    got = {}
    for r in emission.section_token_chunks(sections).collect():
        got.setdefault((r.doc_id, r.section), []).append((r.chunk, r.text, r.tokens))
    assert set(got) == {(1, "a"), (1, "b"), (2, "a")}
    assert [x[1] for x in got[2, "a"]] == ["a text"] and [x[0] for x in sorted(got[1, "b"])] == list(range(len(got[1, "b"])))
    assert [x[1] for x in sorted(got[1, "a"])] == [x[0] for x in chunking.token_chunks("one.\n\ntwo.\n\nn: d\n\nonly")]
    assert len(got[1, "b"]) > 1 and all(n <= chunking.HARD for _, _, n in got[1, "b"])


def test_export_is_resumed(spark, tmp_path):
    sections, titles = corpus(spark)
    more = sections.unionByName(spark.createDataFrame([(i, "s", None, None, f"text {i}") for i in range(10, 40)], SECTIONS))
    path, whole = f"{tmp_path}/a", f"{tmp_path}/b"
    schema = "doc_id long, chunk_id string, section string, chunk int, text string, embedding_text string, digest string"
    assert emission.emitted(more, titles, path, "title_section", slices=4, upto=2) == 0
    first = resumable.committed(spark, path, schema).select("doc_id").distinct().count()
    assert 0 < first < 32 and emission.emitted(more, titles, path, "title_section", slices=4) == first
    emission.emitted(more, titles, whole, "title_section")
    rows = lambda p: sorted(map(tuple, resumable.committed(spark, p, schema).collect()))
    assert rows(path) == rows(whole) and len({r[1] for r in rows(path)}) == len(rows(path))
    by = {r[0]: r for r in rows(path) if r[2] == "a" and r[0] == 2}
    assert by[2][5] == "제목: P\n섹션: a\n\n본문:\na text" and by[2][6] == hashlib.sha256(by[2][5].encode()).hexdigest()
    a, b = emission.summary(spark, path).first(), emission.summary(spark, whole).first()
    assert a == b and (a.documents, a.sections, a.chunks, a.over) == (32, 33, len(rows(path)), 0) and sum(a.by_boundary.values()) == a.chunks


def test_variants_of_titles_and_keys(spark):
    sections, titles = corpus(spark)
    chunks = emission.section_token_chunks(sections.where("doc_id = 2"))
    assert emission.records(chunks, titles, "retrieval_title_section").first().embedding_text.startswith("제목: R\n")
    with pytest.raises(ValueError):
        emission.records(chunks, titles, "other")
    keys = {emission.cache_key("c", 1, "m", n, v) for n in (8, 9) for v in ("a", "b")}
    assert len(keys) == 4 and all(len(k) == 16 for k in keys)
