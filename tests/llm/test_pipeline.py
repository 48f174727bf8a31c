"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from lumispark.llm import mixing
from lumispark.llm.common import BATCH, BATCH_BYTES
from tests.llm.test_operators import documents, toxic_corpus, write


def test_stages(spark, tmp_path):
    docs, labels = toxic_corpus(spark, 300)
    planted = [(5000, "the quick brown fox " * 30 + "token = abcdefghijklmnop", "s"), (5001, "the quick brown fox " * 30 + "token = abcdefghijklmnop", "s"), (5001, "the quick brown fox " * 30 + "token = abcdefghijklmnop", "s")]
    sf = write(spark, tmp_path, documents=docs.unionByName(documents(spark, planted)), labels=labels)
    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, sf)
        assert i == len(pipeline.STAGES) - 1 or out.columns == list(pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/stage{i}")
        now = seen[name] = spark.read.parquet(f"{tmp_path}/stage{i}")
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    left = {r["doc_id"] for r in seen["toxicity"].collect()}
    assert len(toxic & left) <= 3 and {r["doc_id"] for r in labels.where("toxic = 0").collect()} <= left
    after = [r["doc_id"] for r in seen["near duplicates"].collect()]
    assert after.count(5000) == 1 and 5001 not in after and after.count(1006) == 1 and 1007 not in after and 1008 not in after
    masked = {r["doc_id"]: r["text"] for r in seen["secrets"].collect()}
    assert "[SECRET]" in masked[5000] and "abcdefghijklmnop" not in masked[5000]
    assert seen["mixing"].where("length(text) <> n_chars").count() == 0 and seen["packing"].count() > 0


def test_empty_table(spark, tmp_path):
    docs, labels = documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sf = write(spark, tmp_path, documents=docs, labels=labels)
    assert pipeline.run(spark, sf).count() == 0


def _batches(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])


@pytest.mark.parametrize("given", [None, "16m"])
def test_python_workers_get_texts_a_few_bytes_at_a_time(spark, tmp_path, given):
    own = spark.newSession()  # its settings end with it
    own.conf.unset(BATCH_BYTES)
    if given:
        own.conf.set(BATCH_BYTES, given)
    documents(spark, [(i, f"w{i} " * 5000, "s") for i in range(400)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    docs = own.read.parquet(f"{tmp_path}/in").coalesce(1)
    whole = own.conf.get(BATCH_BYTES)
    packed = sorted(tuple(r) for r in pipeline.pack(own, docs, "").collect())
    sizes = [r["size"] for r in docs.mapInArrow(_batches, "size long").collect()]
    if given:
        assert own.conf.get(BATCH_BYTES) == given and len(sizes) == 1  # the user's limit stays
    else:
        assert sum(sizes) > 4 * BATCH and max(sizes) < 1.1 * BATCH
        other = spark.newSession()
        other.conf.set(BATCH_BYTES, whole)
        assert packed == sorted(tuple(r) for r in pipeline.pack(other, other.read.parquet(f"{tmp_path}/in").coalesce(1), "").collect())


def test_mixing_starts_no_workers_for_its_table_of_sources(spark, capsys):
    mixing.mix(documents(spark, [(i, "one two three", f"s{i % 3}") for i in range(30)]))[1].explain()
    plan = capsys.readouterr().out
    assert "LocalTableScan" in plan and "source_size" not in "".join(x for x in plan.splitlines() if "ExistingRDD" in x) and "blocks" not in "".join(x for x in plan.splitlines() if "ExistingRDD" in x)


def test_mixing_stage_sends_no_slots_through_the_driver(spark, capsys):
    own = spark.newSession()  # its settings end with it
    own.conf.set("spark.sql.adaptive.enabled", "false")
    docs = documents(own, [(i, " ".join(f"d{i}w{j}" for j in range(64)), f"s{i % 3}") for i in range(60)])
    mixed = pipeline.mix_sources(own, docs, "")
    mixed.explain()
    joins = [x for x in capsys.readouterr().out.splitlines() if "Join" in x and "block#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    assert mixed.columns == list(pipeline.COLUMNS) and mixed.count() > 30
