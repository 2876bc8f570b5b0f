"""The pipeline's stages, each judged on its own input, and run() as a whole."""

import collections
import os
import re

import pytest

import corpus_pipeline
from corpusflow.llm import mixing, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = text.translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables on this machine")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        results[name] = (docs.collect(), None)
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "sharding" or docs.columns == columns
        results[name] = (results[name][0], docs.collect())

    before, after = results["quality_rules"]
    good = {r["doc_id"] for r in after}
    assert 0 < len(after) < len(before)
    assert all(len(WORD.findall(r["text"])) >= 50 for r in after)
    judged = quality.assess(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert good == {r["doc_id"] for r in judged if r["kept"]}

    before, after = results["near_dedup"]
    kept = {r["doc_id"]: shingles(r["text"]) for r in after}
    for r in before:  # a dropped document is similar to some other that came in
        if r["doc_id"] not in kept:
            mine = shingles(r["text"])
            assert max(len(mine & (s := shingles(o["text"]))) / len(mine | s) for o in before if o["doc_id"] != r["doc_id"]) > 0.5
    ids = list(kept)
    assert not any(len(kept[a] & kept[b]) / len(kept[a] | kept[b]) >= 0.9 for i, a in enumerate(ids) for b in ids[:i])

    before, after = results["decontamination"]
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [norm(r["text"]).split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {" ".join(w[i : i + 8]) for w in items for i in range(len(w) - 7)}
    leaks = {r["doc_id"] for r in before if any(f" {g} " in f" {norm(r['text'])} " for g in grams)}
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} >= leaks

    before, after = results["mixing"]
    size = lambda r: len(WORD.findall(r["text"]))
    want = {r["source"]: r["target"] for r in mixing.plan_mix(spark.read.parquet(str(tmp_path / "decontamination"))).collect()}
    got, most = collections.Counter(), collections.Counter()
    for r in after:
        got[r["source"]] += size(r)
    for r in before:
        most[r["source"]] = max(most[r["source"]], size(r))
    assert all(abs(got[s] - t) <= most[s] / 2 + 1 for s, t in want.items())

    before, after = results["sharding"]
    assert len(after) == len(before)
    slots = collections.defaultdict(list)
    for r in after:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables on this machine")
def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
