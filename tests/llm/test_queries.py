"""The registered queries against their SQL, and the pipeline stage by stage against brute force."""

import hashlib
import math

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stancelab.llm import oracles, queries
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.parity import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_all_operators_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(oracles.oracle_sql()) <= set(queries.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_matches_sql(spark, con, name):
    problems = compare(spark, con, name, SF_SMALL, queries.queries()[name], oracles.oracle_sql()[name])
    assert not problems, problems


def shard_of(doc_id, n):
    return min((-math.log((int(hashlib.md5(f"{doc_id}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52), i)
               for i in range(n))[1]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {0: docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        out = stage(spark, docs, SF_SMALL)
        if i < 5:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[i] = docs.collect()
    before = {r["doc_id"]: r for r in rows[0]}
    # toxicity: the kept rows are unchanged, and nearly all labels are met
    assert all(tuple(before[r["doc_id"]]) == tuple(r) for r in rows[1])
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows[1]}
    clean = [d for d, t in toxic.items() if t == 0]
    assert sum(d in kept for d in clean) >= 0.9 * len(clean)
    # near-dedup: one document of each component
    near = brute.near([(r["doc_id"], r["text"]) for r in rows[1]], 5, 80)
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(d for d, _, c in near if d == c)
    # decontamination: no window is left, untouched documents pass, others shrink or go
    leaks = {d: (n, h) for d, n, h, _ in brute.leaks([(r["doc_id"], r["text"]) for r in rows[2]], items, 10)}
    text = {r["doc_id"]: r["text"] for r in rows[2]}
    assert {r["doc_id"] for r in rows[3]} == {d for d, (n, h) in leaks.items() if h == 0 or h < 0.5 * n}
    assert all((r["text"] == text[r["doc_id"]]) == (leaks[r["doc_id"]][1] == 0) for r in rows[3])
    assert not any(h for *_, h, _ in brute.leaks([(r["doc_id"], r["text"]) for r in rows[3]], items, 10))
    # mixing: whole copies, near the targets
    sizes, most = {}, {}
    for r in rows[3]:
        n = len(brute.words(r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        most[r["source"]] = max(most.get(r["source"], 0), n)
    target, taken, times = brute.fill(sizes), {}, {}
    for r in rows[4]:
        taken[r["source"]] = taken.get(r["source"], 0) + len(brute.words(r["text"]))
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2
    assert all(abs(taken.get(s, 0) - t) <= most[s] / 2 + 1 for s, t in target.items())
    # sharding: every row, where its id says, slots without gaps
    assert len(rows[5]) == len(rows[4])
    slots = {}
    for r in rows[5]:
        assert r["shard"] == shard_of(r["doc_id"], 24) and r["grown_shard"] == shard_of(r["doc_id"], 25)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
