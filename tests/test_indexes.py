"""The life of an index version: staged, served, promoted and rolled back."""

import pytest

from corvane.operators import indexes as I


def state(df):
    return {r.version: (r.status, r.active, r.previous) for r in df.collect()}


def test_promotion_needs_a_passed_evaluation(spark):
    builds = I.with_build(I.with_build(spark.createDataFrame([], I.BUILDS), "v1", 1), "v2", 2)
    with pytest.raises(ValueError):
        I.promoted(builds, "v1", 3)
    evals = spark.createDataFrame([("v1", "e1", True), ("v2", "e0", False), ("v2", "e2", True), ("v9", "e3", True)], "version string, eval string, passed boolean")
    builds = I.promoted(I.with_eval(builds, evals), "v1", 3)
    assert state(builds) == {"v1": ("PROMOTED", True, None), "v2": ("EVAL_PASSED", False, None)}
    builds = I.promoted(builds, "v2", 4)
    assert state(builds) == {"v1": ("RETIRED", False, None), "v2": ("PROMOTED", True, "v1")}
    assert state(I.rolled_back(builds, "v2", 5)) == {"v1": ("PROMOTED", True, None), "v2": ("ROLLED_BACK", False, "v1")}
    with pytest.raises(ValueError):
        I.rolled_back(builds, "v7", 5)


def test_staged_vectors_are_served_when_named(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    assert I.manifest(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        I.loaded(spark, folder)
    for version, n in (("v1", 3), ("v2", 5)):
        path = I.stage(spark.range(n).withColumnRenamed("id", "row_id"), folder, version)
        I.serve(spark, folder, path, version, "m")
        assert I.manifest(spark, folder) == {"index_version": version, "embedding_model": "m"} and I.loaded(spark, folder).count() == n


def test_callers_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = f"file://{tmp_path}/index"
    path = I.stage(spark.range(2).withColumnRenamed("id", "row_id"), folder, "v")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: I.serve(spark, folder, path, f"v{i}", "m"), range(8)))
    names = I._names(spark, folder)
    assert len(names) == 8 and I.manifest(spark, folder)["index_version"] in (tmp_path / "index/manifests" / names[-1]).read_text()
    I.serve(spark, folder, path, "last", "m")
    (tmp_path / "index/manifests/000000000099-x.json").write_text('{"path": "to')
    assert I.manifest(spark, folder)["index_version"] == "last" and I.loaded(spark, folder).count() == 2
