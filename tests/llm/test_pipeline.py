"""The pipeline's stages, each read from what the one before has written."""

import pytest

from skyframe import session
from skyframe.llm import decontaminate, near_dedup, pii, toxicity


def test_stages_and_run(spark, data, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels, bench = spark.read.parquet(f"{data}/labels.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    seen = [{r.doc_id for r in docs.collect()}]
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.toxicity(before, labels).collect() if r.predicted == 0}
        elif name == "near_dedup":
            want = {r.doc_id for r in near_dedup.near_duplicates(before).collect() if r.kept}
        elif name == "decontamination":
            want = seen[-1] - {r.doc_id for r in decontaminate.find_leaks(before, bench).collect()}
        else:
            want = seen[-1]
        assert set(ids) == want
        if name != "packing":
            assert len(ids) == len(want) and docs.columns == before.columns
        if name == "pii":
            assert all(not r.spans for r in pii.find_pii(docs).collect())
        seen.append(set(ids))
    whole = P.run(spark, data)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


def test_nothing_is_left_of_a_run_that_fails(spark, data, monkeypatch):
    import corpus_pipeline as P

    def breaks(spark, docs, sf_dir):
        raise ValueError("a stage failed")

    made = []
    monkeypatch.setattr(P, "Scratch", lambda spark: made.append(session.Scratch(spark)) or made[-1])
    monkeypatch.setattr(P, "STAGES", [("same", lambda spark, docs, sf_dir: docs), ("breaks", breaks)])
    with pytest.raises(ValueError, match="a stage failed"):
        P.run(spark, data)
    path = spark._jvm.org.apache.hadoop.fs.Path(made[0].folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
