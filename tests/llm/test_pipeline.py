"""The pipeline, each stage on what its predecessor kept, against brute force."""

from __future__ import annotations

import re

import pytest

from arbora.llm import mixing, quality, queries
from arbora.llm.common import staged
from tests.llm.test_table_operators import near_by_hand
from tests.llm.test_text_operators import base_by_hand, ids_of

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram jaccard join", "secret scans", "mixing to target weights", "packing"]
    rows = {r["doc_id"]: r for r in docs.collect()}

    kept = staged(stages["quality rules"](spark, docs, sf_dir), "one")
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    got = {r["doc_id"]: r for r in kept.collect()}
    assert got.keys() == want and all(got[k] == rows[k] for k in got)

    single = staged(stages["n-gram jaccard join"](spark, kept, sf_dir), "two")
    assert single.columns == docs.columns
    groups = near_by_hand([(k, r["text"]) for k, r in got.items()])
    got = {r["doc_id"]: r for r in single.collect()}
    assert got.keys() == {c for _, _, c in groups} and all(got[k] == rows[k] for k in got)

    clean = staged(stages["secret scans"](spark, single, sf_dir), "three")
    assert clean.columns == docs.columns
    found = {r["doc_id"]: r for r in clean.collect()}
    assert found.keys() == got.keys()
    for k, r in found.items():
        old, spans = got[k]["text"], base_by_hand(got[k]["text"])
        assert r["n_chars"] == len(r["text"]) and not base_by_hand(r["text"])
        if "[secret]" not in r["text"]:
            assert r["text"] == old and not spans
        else:  # what is left stands in the old text in order
            assert re.fullmatch(".*?".join(map(re.escape, re.split(r"\[secret\]", r["text"]))), old, re.DOTALL)

    mixed = staged(stages["mixing to target weights"](spark, clean, sf_dir), "four")
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.sampled(clean).collect()}
    times: dict = {}
    for r in mixed.collect():
        assert r == found[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {k: n for k, n in copies.items() if n}

    pieces = stages["packing"](spark, mixed, sf_dir).collect()
    lengths: dict = {}
    for p in pieces:
        lengths[p["doc_id"]] = lengths.get(p["doc_id"], 0) + p["length"]
    names = sorted(times)
    want = {k: times[k] * (len(ids) + 1) for k, ids in zip(names, ids_of([found[k]["text"] for k in names]), strict=True)}
    assert lengths == want


def test_run_and_extra_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = str(tmp_path / "sf")
    docs.limit(60).selectExpr("*", "1 AS row", "'x' AS base", "2.5 AS kept", "doc_id AS size").write.parquet(f"{folder}/documents.parquet")
    got = pipeline.run(spark, folder)
    assert got.count() > 0 and got.columns[0] == "doc_id"
    docs.limit(0).write.parquet(f"{folder}-empty/documents.parquet")
    assert pipeline.run(spark, f"{folder}-empty").count() == 0


def test_ablations_of_the_first_stage(spark, sf_dir):
    """What each rule rejects, and rejects alone, from the failure bits of all documents."""
    got = {r["rule"]: (r["rejected"], r["rejected_alone"]) for r in pipeline.ablations(spark, sf_dir).collect()}
    bits = [r["failed"] for r in queries.op8_rule_ledger(spark, sf_dir).collect()]
    assert got == {name: (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits)) for k, (name, _) in enumerate(quality.RULES)}
    assert sum(n for n, _ in got.values()) > 0
