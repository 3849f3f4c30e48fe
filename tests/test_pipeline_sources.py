"""Study-shaped flows, the streaming effect, and file sources/sinks."""

import os
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stancelab.plans import pipeline as pl
from stancelab.sources import files as fl
from stancelab.sources.tables import require_columns
from stancelab.streaming.effects_stream import effect_stream, read_published, start_effect_stream

RESP_SCHEMA = ("completion string, completion_no int, prompt_no int, question_no int, issue_no int, "
               "issue_no_key double, keyword string, ending string, end_type string, labels string, "
               "partisanship int, liberal int, named_prime int, proj double, proj_b int, full_prompt string")


def responses(spark, n=20):
    random.seed(7)
    rows = []
    q = 0
    for issue, keywords in ((0, ["closing businesses", "keeping businesses open"]), (1, ["masks"]), (2, [None])):
        for kpos, kw in enumerate(keywords):
            for ending in ("I think", "In my opinion"):
                for part in (0, 1):
                    prompt_no = 2 * q + part
                    shift = 0.2 if issue == 0 else (-0.2 if issue == 1 else 0.0)
                    for c in range(n):
                        lib = 1 - part
                        y = random.gauss(shift * lib, 0.05)
                        rows.append((f"c{c}", c, prompt_no, q, issue, issue + 0.1 * (kpos + 1), kw, f" {ending} x",
                                     f"{ending}...", "good idea,bad idea", part, lib, 1, y, int(y > 0), "fp"))
                q += 1
    rows.append(("n", 0, 99, 99, 0, 0.1, "k", "e", "t", "a,b", 0, None, 1, 0.3, 1, "fp"))       # null x
    rows.append(("n", 1, 99, 99, 0, 0.1, "k", "e", "t", "a,b", 0, 1, 1, float("nan"), 1, "fp"))  # NaN y
    rows.append(("n", 2, 98, 98, 0, None, "k", "e", "t", "a,b", 0, 1, 1, 0.1, 1, "fp"))          # null key
    rows.append(("n", 3, 97, 97, 0, 0.1, "k", "e", "t", "a,b", 0, 1, 0, 5.0, 1, "fp"))           # unnamed prime
    return spark.createDataFrame(rows, RESP_SCHEMA)


def test_effects_flow(spark):
    bank = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "issue_no int, reverse_code int")
    out = pl.effects_flow(responses(spark), bank, topics={"a": [0, 1], "b": [2]},
                          expected_shape={"rows": 324, "prompts": 19, "questions": 11},
                          expected_counts={"correct": 6, "wrong": 0, "no_effect": 3})
    coefs = out["coefficients"].collect()
    # 8 wordings + the question whose rows are all dropped (null x, NaN y); the null key
    # and the unnamed prime drop out
    assert len(coefs) == 9
    by = {(r.issue_no_key, r.question_no): r for r in coefs}
    assert by[(0.1, 0)].direction == "liberal" and by[(1.1, 4)].direction == "conservative"
    assert by[(0.1, 99)].n == 0 and by[(0.1, 99)].coef is None
    counts = {r.verdict: r.n for r in out["verdict_counts"].collect()}
    # issue 0 is an override (keywords) -> liberal expected: correct; issue 1 reverse 1 -> correct
    assert counts["correct"] == 6 and counts["wrong"] == 0
    checks = {r.check: r.status for r in out["checks"].collect()}
    assert checks["covid_response_shape"] == "pass" and checks["forecast_counts"] == "pass"
    topics = {r.topic_group for r in out["coefficients_by_topic"].collect()}
    assert topics == {"a", "b"}
    panels = {(r.topic_group, r.issue_no_key, r.question_no): r for r in out["panels"].collect()}
    assert panels[("a", 0.1, 0)].panel_no == 1 and panels[("a", 0.2, 2)].panel_no == 2
    assert panels[("a", 0.1, 1)].x_pos == 1 and panels[("a", 0.1, 0)].panel_label == "closing businesses"
    assert panels[("b", 2.1, 6)].panel_label == "2.1"
    d = tempfile.mkdtemp(prefix="flow-")
    pl.write_outputs({"coefficients_by_topic": out["coefficients_by_topic"], "checks": out["checks"]}, d, fmt="csv")
    assert os.path.isdir(os.path.join(d, "coefficients_by_topic", "topic_group=a"))


def test_contract(spark):
    df = spark.createDataFrame([(1,)], "named_prime int")
    try:
        require_columns(df)
    except ValueError as exc:
        assert "full_prompt" in str(exc) and "issue_no_key" in str(exc)
    else:
        raise AssertionError("missing columns not reported")


def test_tests_flow(spark):
    rows = [("d1", "a", 1)] * 30 + [("d1", "a", 0)] * 10 + [("d1", "ref", 1)] * 10 + [("d1", "ref", 0)] * 10 + \
           [("d1", "b", 1)] * 5 + [("d1", "b", 0)] * 5
    labelled = spark.createDataFrame(rows, "domain string, category string, liberal int")
    comps = spark.createDataFrame([("d1", "a", "ref", 1), ("d1", "b", "ref", 2)],
                                  "domain string, right string, left string, test_no int")
    out = pl.tests_flow(labelled, comps)
    bars = {r.category: r for r in out["bars"].collect()}
    assert set(bars) == {"a", "ref", "b"} and bars["ref"].p_value_greater is None
    assert bars["a"].p_value_greater < 0.05
    seg = {r.category: r for r in out["segments"].collect()}
    assert seg["a"].star and abs(seg["a"].y_limit - 40 * 1.14) < 1e-9 and seg["a"].figure_group == "d1"
    study = spark.createDataFrame([("vaccine_get", "x", 1), ("vaccine_get", "y", 0), ("vaccine_not_get", "x", 1),
                                   ("vaccine_not_get", "y", 1)], "domain string, category string, liberal int")
    comps = spark.createDataFrame([("vaccine_get", "x", "y", 1), ("vaccine_not_get", "x", "y", 2)],
                                  "domain string, right string, left string, test_no int")
    figs = {r.figure_group for r in pl.tests_flow(study, comps)["segments"].collect()}
    assert figs == {"vaccine"}


def test_streaming_effect_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="stream-src-")
    resp = responses(spark)
    resp.repartition(3).write.mode("overwrite").parquet(src + "/batch1")
    from stancelab.operators.effects import two_group_effect
    stream = effect_stream(spark, src + "/batch1", RESP_SCHEMA, ["issue_no_key", "question_no"], "liberal", "proj")
    q = (stream.writeStream.outputMode("complete").format("memory").queryName("effects_stream_test")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {(r.issue_no_key, r.question_no): r for r in spark.table("effects_stream_test").collect()}
    want = {(r.issue_no_key, r.question_no): r for r in two_group_effect(
        resp, ["issue_no_key", "question_no"], "liberal", "proj").collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert g.n == w.n and g.direction == w.direction
        assert (g.coef is None and w.coef is None) or abs(g.coef - w.coef) < 1e-12


def test_file_inventory_and_landing(spark):
    d = tempfile.mkdtemp(prefix="inv-")
    vec_dir, txt_dir = os.path.join(d, "vec"), os.path.join(d, "txt")
    os.makedirs(vec_dir)
    os.makedirs(txt_dir)
    for name, n, dim in (("pos_embed_3_1_2_fin", 4, 5), ("neg_embed_3_2_2_fin", 2, 5)):
        pd.DataFrame({"embedding": [[0.5] * dim] * n}).to_parquet(os.path.join(vec_dir, name + ".parquet"))
    pd.DataFrame({"text": ["t"]}).to_parquet(os.path.join(txt_dir, "pos_lst_3_1.parquet"))
    with open(os.path.join(vec_dir, "pos_embed_4_1_2_fin.parquet"), "wb") as fh:   # unreadable file
        fh.write(b"not a parquet file")
    rows = fl.file_inventory(spark, vec_dir, txt_dir).collect()
    errors = [r.embedding_file for r in rows if r.error]
    assert errors == ["pos_embed_4_1_2_fin.parquet"]
    inv = {(r.sentiment, r.connector): r for r in rows if not r.error}
    assert inv[("pos", 1)].n == 4 and inv[("pos", 1)].dimensions == 5 and inv[("pos", 1)].prompt_no == 3
    assert inv[("pos", 1)].text_file == "pos_lst_3_1.parquet" and inv[("neg", 2)].text_file == ""
    # an empty file counts 0; one damaged after its first row groups says what is missing
    import pyarrow as pa
    import pyarrow.parquet as pq
    kind = pa.schema([("embedding", pa.list_(pa.float64()))])
    pq.write_table(kind.empty_table(), os.path.join(vec_dir, "pos_embed_5_1_2_fin.parquet"))
    many = pa.table({"embedding": [[random.random()] * 3 for _ in range(3000)]}, schema=kind)
    broken = os.path.join(vec_dir, "pos_embed_6_1_2_fin.parquet")
    pq.write_table(many, broken, row_group_size=1000, compression="snappy", use_dictionary=False)
    meta = pq.ParquetFile(broken).metadata
    at = meta.row_group(2).column(0).data_page_offset
    with open(broken, "r+b") as fh:
        fh.seek(at)
        fh.write(b"\xff" * 64)
    again = {r.embedding_file: r for r in fl.file_inventory(spark, vec_dir, txt_dir).collect()}
    empty, part = again["pos_embed_5_1_2_fin.parquet"], again["pos_embed_6_1_2_fin.parquet"]
    assert (empty.n, empty.prompt_no, empty.error) == (0, 5, None)
    assert part.n < 3000 and part.error == f"read {part.n} of 3000 vectors" and len(again) == 5
    # a saved summary stands in when the cache folder is gone
    saved = os.path.join(d, "saved_summary")
    spark.createDataFrame([(3, 1, "pos", 4)], "prompt_no int, connector int, sentiment string, n long") \
        .write.parquet(saved)
    assert fl.file_inventory(spark, os.path.join(d, "gone"), summary_path=saved).first().n == 4
    # gzip landing (S2) and the JSON summary sink
    import gzip
    gz = os.path.join(d, "r.csv.gz")
    with gzip.open(gz, "wt", encoding="utf-8") as fh:
        fh.write('a,b\n1,"x, y"\n2,z\n')
    landed = fl.land_csv(spark, gz, os.path.join(d, "landed"), partitions=2)
    assert sorted((r.a, r.b) for r in landed.collect()) == [("1", "x, y"), ("2", "z")]
    fl.write_summary(fl.summary_row(spark, {"rows": 2, "files": 1}), os.path.join(d, "summary"))
    assert spark.read.json(os.path.join(d, "summary")).columns == ["files", "rows"]


def test_points_from_files_and_limit(spark):
    d = tempfile.mkdtemp(prefix="pts-")
    pd.DataFrame({"embedding": [[float(i), 1.0] for i in range(5)]}).to_parquet(
        os.path.join(d, "pos_embed_7_2_2_fin.parquet"))
    pts = sorted((r.prompt_no, r.connector, r.sentiment, r.position, r.embedding[0])
                 for r in fl.slice_points_from_files(spark, d).collect())
    assert pts == [(7, 2, "pos", i, float(i)) for i in range(5)]
    from stancelab.operators.prompts import justification_prompts
    resp = spark.createDataFrame([(p, c, "fp", f"c{p}{c}") for p in range(3) for c in range(4)],
                                 "prompt_no int, completion_no int, full_prompt string, completion string")
    head = [r.justification_prompt for r in justification_prompts(resp, limit=5).collect()]
    assert head == [f"fp c{p}{c}. This is because" for p, c in [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0)]]


def test_stream_publishes_and_resumes(spark):
    base = tempfile.mkdtemp(prefix="stream-run-")
    src, sink, ckpt = (os.path.join(base, d) for d in ("src", "sink", "ckpt"))
    resp = responses(spark)
    first = resp.where(F.col("question_no") < 4)
    first.write.mode("append").parquet(src)
    args = (spark, src, RESP_SCHEMA, ["issue_no_key", "question_no"], "liberal", "proj", ckpt, sink)
    start_effect_stream(*args, available_now=True).awaitTermination(120)
    assert read_published(spark, sink).count() == 4
    # a second file arrives; the restarted query continues from its checkpoint
    resp.where(F.col("question_no") >= 4).write.mode("append").parquet(src)
    start_effect_stream(*args, available_now=True).awaitTermination(120)
    out = {(r.issue_no_key, r.question_no): r.n for r in read_published(spark, sink).collect()}
    assert len(out) == 10 and out[(0.1, 0)] == 40   # 8 wordings + questions 97 and 99
    # the pointer names the last whole folder; a crash while it moves leaves the new one to read
    os.rename(os.path.join(sink, "_current"), os.path.join(sink, "_current.new"))
    assert read_published(spark, sink).count() == 10
    with pytest.raises(ValueError):
        read_published(spark, base)


def test_run_study_over_registered_tables(spark):
    from stancelab.sources.tables import table_path
    root, out = tempfile.mkdtemp(prefix="study-"), tempfile.mkdtemp(prefix="study-out-")
    responses(spark).write.parquet(table_path(root, "covid"))
    spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "issue_no int, reverse_code int") \
        .write.parquet(table_path(root, "bank_covid"))
    spark.createDataFrame([("d", "a", 1), ("d", "a", 0), ("d", "ref", 0)],
                          "domain string, category string, liberal int").write.parquet(
        table_path(root, "justification_labels"))
    spark.createDataFrame([("d", "a", "ref", 1)], "domain string, right string, left string, test_no int") \
        .write.parquet(table_path(root, "justification_comparisons"))
    arch = [("p1", i, [float(i % 2) * 10.0, 0.0]) for i in range(8)]
    spark.createDataFrame(arch, "archive_file string, row_no long, embedding array<float>").write.parquet(
        table_path(root, "embedding_archive"))
    spark.createDataFrame([(1, 1, "pos", "p1", 0, 8)], "prompt_no int, connector int, sentiment string, "
                          "archive_file string, archive_offset long, n long").write.parquet(
        table_path(root, "embedding_manifest"))
    spark.createDataFrame([(1, 1, "pos", j, f"t{j}") for j in range(8)], "prompt_no int, connector int, "
                          "sentiment string, justification_no long, justification string").write.parquet(
        table_path(root, "justification_texts"))
    ran = pl.run_study(spark, root, out, datasets={"covid": {"a": [0, 1], "b": [2]}}, k=2, restarts=1)
    assert ran == ["effects_covid", "tests", "clusters"]
    clusters = spark.read.parquet(os.path.join(out, "clusters", "assignments")).collect()
    assert len(clusters) == 8 and len({(r.cluster, r.point_id % 2) for r in clusters}) == 2
    assert spark.read.parquet(os.path.join(out, "effects_covid", "coefficients")).count() == 9
    assert spark.read.parquet(os.path.join(out, "tests", "bars")).count() == 2


def test_footers_of_large_and_many_files(spark, tmp_path):
    """Only the end of a file is read: three gigabytes with a hole in front are as quick as any."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    small = tmp_path / "small.parquet"
    pq.write_table(pa.table({"embedding": [[0.5, 1.0]] * 7}), small)
    folder = tmp_path / "vectors with blanks"
    folder.mkdir()
    with open(folder / "pos_embed_1_1_2_fin.parquet", "wb") as f:
        f.seek(3 << 30)
        f.write(small.read_bytes())
    for i in range(300):
        (folder / f"neg_embed_{i}_1_2_fin.parquet").write_bytes(small.read_bytes() if i else b"broken")
    (folder / "other.parquet").write_bytes(small.read_bytes())
    got = {r.embedding_file: r for r in fl.file_footers(spark, str(folder)).collect()}
    assert len(got) == 301 and got["pos_embed_1_1_2_fin.parquet"].promised == 7
    assert got["neg_embed_0_1_2_fin.parquet"].promised is None and got["neg_embed_0_1_2_fin.parquet"].error
    assert sum(r.promised or 0 for r in got.values()) == 7 * 300
    plan = fl.file_footers(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
