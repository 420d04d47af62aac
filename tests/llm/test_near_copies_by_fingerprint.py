import random

import corpus_pipeline
from corvane.llm import near_copies
from test_near_copies import sets


def test_fingerprints_find_groups_without_the_shingle_index(spark, tmp_path, monkeypatch):
    draw = random.Random(4)
    texts = []
    for _ in range(30):
        base = [f"w{draw.randrange(3000)}" for _ in range(900)]
        texts += [" ".join(base), " ".join([*base[:450], "changed", *base[451:]])]
    texts += [f"short text number {i}" for i in range(20)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    monkeypatch.setattr(near_copies, "_posted", lambda texts, words: texts.sparkSession.createDataFrame([], near_copies.POST))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()}
    assert set(range(0, 60, 2)) <= kept and set(range(60, 81)) <= kept and 81 not in kept
    assert len(kept & set(range(1, 60, 2))) <= 3


def test_links_by_fingerprint_are_confirmed_by_whole_sets(spark):
    draw = random.Random(5)
    base = [f"w{draw.randrange(9)}" for _ in range(60)]
    texts = [" ".join(base[:i] + [f"x{draw.randrange(3)}"] + base[i:]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {near_copies.node_of(t.encode()): sets(t) for t in texts}
    links = near_copies.fingerprinted(docs, near_copies.nodes(docs)).collect()
    assert links and all(5 * len(of[r.a] & of[r.b]) >= 4 * len(of[r.a] | of[r.b]) for r in links)
