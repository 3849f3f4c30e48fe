"""Stages that hand whole texts to Python: few rows a batch, one Python step a job."""

import contextlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from stancelab.llm import bigru, scratch
from stancelab.llm.decontam import decontaminate


class Jobs:
    """What the tables of a run were made of: Python steps in a job, and the session's rows a batch meanwhile."""

    def __init__(self, spark, monkeypatch):
        self.seen = []
        batches_of = scratch._batches_of

        @contextlib.contextmanager
        def noted(session, rows):
            with batches_of(session, rows):
                self.limit = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
                yield

        def table(cut, df, *a, **b):
            out = write(cut, df, *a, **b)
            self.seen.append((python_steps(df), self.limit))
            return out

        write = scratch.Scratch.table
        monkeypatch.setattr(scratch, "_batches_of", noted)
        monkeypatch.setattr(scratch.Scratch, "table", table)


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0].count("MapInArrow")


def test_toxicity_stage_hands_texts_over_in_small_batches(spark, tmp_path, monkeypatch):
    hashes = bigru.read_words(pa.array(["nasty"])).hash
    monkeypatch.setattr(corpus_pipeline, "train", lambda docs, labels: bigru.BiGru(hashes, np.full(1, 9.0)))
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "fine", "a"), (1, "nasty", "b"), (1, None, "c"), (2, "so nasty", "d"), (2, "so nasty", "e"),
            (None, "nasty", "f"), (None, "fine", "g"), (None, None, "h"), (3, "", "i"), (4, "fine", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string")
    jobs = Jobs(spark, monkeypatch)
    out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in docs.collect() if "nasty" not in (r["text"] or ""))
    assert jobs.seen == [(1, scratch.TEXT_ROWS)] and python_steps(out) == 0
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_decontamination_has_one_python_step_a_job_and_small_batches(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("t", " ".join(words[20:32]))], "item_id string, text string")
    jobs = Jobs(spark, monkeypatch)
    out = {r["doc_id"]: r["text"] for r in decontaminate(docs, bench).collect()}
    assert out == {1: " ".join([*words[:20], "", *words[32:]]), 2: "nothing of it", 3: None}
    assert len(jobs.seen) == 3 and set(jobs.seen) == {(1, scratch.TEXT_ROWS)}
