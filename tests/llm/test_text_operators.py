"""Operators on documents against brute force, on a small table full of awkward rows."""

import pathlib
import random
import textwrap

import pytest
from pyspark.sql import functions as F

from stancelab.llm import licenses
from stancelab.llm.decontam import SuffixAutomaton, decontaminate, find_overlaps
from stancelab.llm.idfilter import mark_suspects
from stancelab.llm.licenses import KNOWN, known_digests, scan_licenses
from stancelab.llm.mixing import mix_sources, repeat_documents
from stancelab.llm.neardup import near_duplicates
from stancelab.llm.shards import rendezvous, shard_documents
from stancelab.llm.substrings import remove_repeats
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string"


def awkward_rows():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "a b", "x-y", "THE"]
    prose = [" ".join(r.choices(vocabulary, k=r.randint(1, 120))) for _ in range(25)]
    base = " ".join(r.choices(vocabulary, k=90)).split()
    near = []
    for i in range(14):  # a chain of near copies with more and more words replaced
        w = base[:]
        for _ in range(i):
            w[r.randrange(len(w))] = f"n{r.random():.4f}"
        near.append(" ".join(w))
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, t, f"src{i % 4}") for i, t in enumerate(prose + near)]
    rows += [(100, None, None), (101, "", "src1"), (102, " \t\n ", None), (103, None, "src0"), (104, "one", "é"),
             (105, "one two", "é"), (106, prose[3], "src0"), (107, prose[3].upper(), "src1"), (108, prose[3], "src2"),
             (109, prose[1] + " " + shared + " tail", "src3"), (110, "head\n" + shared + "\r\n" + prose[2], "src3"),
             (111, "a " * 100, "src0"), (112, " ".join(r.choices(vocabulary, k=20_000)), "src1"),
             (113, prose[5], "src1"), (113, prose[6], "src1"), (114, prose[7], "src1"), (114, prose[7], "src1"),
             (-5, base[0], "src2")]
    return rows


ROWS = awkward_rows()


@pytest.fixture(scope="module")
def docs(spark):
    # an extra column whose name clashes with the operators' own
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).withColumns(
        {"size": F.lit("mine"), "spans": F.lit(1), "cls": F.lit(2)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def as_is(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    got = listed(near_duplicates(docs, k, percent), "doc_id", "n_shingles", "component_id", "kept")
    want = brute.near([r[:2] for r in ROWS], k, percent)
    assert got == as_is((d, n, c, d == c) for d, n, c in want)
    assert len({c for _, _, c in want}) < len(ROWS) - 5


def test_near_duplicates_of_a_large_group_alike_but_apart(spark, monkeypatch):
    """What is compared within a group of texts that are all alike does not grow with its square."""
    from stancelab.llm import neardup
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in rng.sample(range(150), rng.randint(0, 9)):
            own[at] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i * 7 % 400, " ".join(own)))
    compared, confirm = [], neardup._Linker.confirm

    def counted(self, pairs):
        compared.append(pairs.count())
        return confirm(self, pairs)

    monkeypatch.setattr(neardup._Linker, "confirm", counted)
    got = listed(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85),
                 "doc_id", "n_shingles", "component_id", "kept")
    want = brute.near(rows, 3, 85)
    assert got == as_is((d, n, c, d == c) for d, n, c in want)
    assert 100 < len({c for _, _, c in want}) < 300
    assert max(compared) <= 3 * len(rows), compared


def test_near_duplicates_cuts_a_large_group_into_items_once_and_in_many_tasks(spark, monkeypatch):
    """The items of a group grow as its texts do, each is a row once, and no task has most of them."""
    from pyspark.sql import functions as F

    from stancelab.llm import neardup
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        own = list(base)
        for at in rng.sample(range(150), rng.randint(6, 9)):
            own[at] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(own)))
    cuts, table = [], neardup.Scratch.table

    def watched(self, df, tag="t", **how):
        if n := df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(items"):
            tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            cuts.append((n, sum(tasks), max(tasks)))
        return table(self, df, tag, **how)

    monkeypatch.setattr(neardup.Scratch, "table", watched)
    monkeypatch.setattr(neardup, "WIDE_BAND", 4)  # all but the smallest bands are searched by differences
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for n in (150, 300):
            near_duplicates(spark.createDataFrame(rows[:n], "doc_id long, text string"), 3, 85)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [c[0] for c in cuts] == [1, 1], cuts
    few, many = (c[1] for c in cuts)
    assert 0 < many <= 3 * few, cuts
    assert cuts[1][2] <= many / 3, cuts


def test_near_duplicates_null_ids_and_empty(spark, empty):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (None, "other words here"), (None, None)]
    got = listed(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85),
                 "doc_id", "n_shingles", "component_id", "kept")
    assert got == as_is([(None, 2, 7, False), (None, 2, 7, False), (7, 2, 7, True), (None, 1, None, True),
                         (None, 0, None, True)])
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("window,seed", [(35, 12), (6, 3), (5, 5)])
def test_remove_repeats(docs, window, seed):
    got = remove_repeats(docs, window, seed)
    assert "size" in got.columns
    assert listed(got.withColumn("h", F.sha2("kept_text", 256)), "doc_id", "n_words", "n_removed", "h") == as_is(
        brute.repeats([r[:2] for r in ROWS], window))


def test_remove_repeats_null_ids_and_empty(spark, empty):
    rows = [(None, "a b c x"), (None, "a b c y"), (None, None)]
    got = listed(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 3, 2), "kept_text")
    assert got == [("",), ("x",), ("y",)]
    assert remove_repeats(empty).count() == 0


ITEMS = [(1, "s1 s2 s3 s4 s5 s6 s7 s8 s9 s10 s11 s12"), (2, "ONE, two"), (3, None), (4, "..."), (5, "s20 s21! s22"),
         (6, "s5 s6 s7 s8 s9 s10 s11 s12 s13 s14 s15"), (6, "a a a"), (None, "s1 s2 s3"), (10, "É naïve"),
         (1, "s1 s2 s3 s4 s5 s6 s7 s8 s9 s10 s11 s12")]


@pytest.mark.parametrize("window,block", [(10, 1 << 18), (4, 5), (1, 1 << 18)])
def test_find_overlaps(spark, docs, window, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = find_overlaps(docs, items, window, block_words=block)
    assert {"size", "cls"} <= set(got.columns)
    want = brute.leaks([r[:2] for r in ROWS], [i for i in ITEMS if i[0] is not None], window)
    assert as_is((d, n, h, list(i)) for d, n, h, i in listed(got, "doc_id", "n_words", "n_hit", "items")) == as_is(want)
    assert sum(h > 0 for _, _, h, _ in want) > 2


def test_find_overlaps_without_items(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_overlaps(docs, none).where("n_hit > 0").count() == 0
    assert find_overlaps(empty, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_suffix_automaton_longest_matches():
    r = random.Random(9)
    for _ in range(60):
        texts = [[r.randrange(3) for _ in range(r.randint(0, 9))] for _ in range(4)]
        auto = SuffixAutomaton()
        for t in texts:
            auto.add(t)
        inside = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        stream = [r.randrange(4) for _ in range(30)]
        at = long = 0
        for i, c in enumerate(stream):
            at, long = auto.step(at, long, c)
            assert long == max(n for n in range(i + 2) if n == 0 or tuple(stream[i + 1 - n:i + 1]) in inside)


def test_decontaminate_cuts_or_drops(spark):
    item = "one two three four five six"
    rows = [(1, f"Before it. {item.title()}! after all of that", 9), (2, item, 9), (3, "clean text", 10), (4, None, None), (5, "", 0),
            (6, "p q r s one two three one two three four five six four five six t u v w x y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", F.lit("kept"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate(docs, bench, window=6, coverage=0.6).collect()}
    assert set(got) == {1, 3, 4, 5, 6} and got[3]["text"] == "clean text" and got[4]["text"] is None
    assert got[1]["text"] == "Before it. ! after all of that" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[6]["text"].split() == "p q r s t u v w x y".split()  # the first cut joins a second match
    assert {r["spans"] for r in got.values()} == {"kept"}


def test_items_without_an_id_are_cut_too(spark):
    bench = spark.createDataFrame([(None, "one two three"), (7, "five six seven"), (None, None)], "item_id long, text string")
    table = spark.createDataFrame([(1, "a b One, two three c d e"), (2, "x five six seven y z u v")], "doc_id long, text string")
    for block in (1, 1 << 18):
        got = find_overlaps(table, bench, 3, block_words=block)
        assert listed(got, "doc_id", "n_hit", "items") == [(1, 3, []), (2, 3, ["7"])]
    assert listed(decontaminate(table, bench, 3), "doc_id", "text") == [(1, "a b  c d e"), (2, "x  y z u v")]


def test_mix_sources(docs):
    got = mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "times", "taken").collect()
    assert len(got) == len(ROWS)
    sizes: dict = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    target = brute.fill(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["taken"] == r["times"] * r["size"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own) / 2 + 1
    again = mix_sources(docs.repartition(3)).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()
    first: dict = {}
    for r in got:
        first[r["doc_id"]] = first.get(r["doc_id"], 0) + r["taken"]
    assert {r["doc_id"]: r["n"] for r in again} == first


def test_mix_goes_on_behind_a_long_document(spark, docs):
    rows = [(i, "a " * (3000 if i == 7 else 20 + i), "x" if i < 50 else None) for i in range(60)]
    for table in (docs, spark.createDataFrame(rows, SCHEMA).repartition(3)):
        got = mix_sources(table).withColumn("key", F.md5(F.concat_ws("|", F.lit("mix"), F.col("doc_id").cast("string"),
                                                                      F.md5(F.coalesce("text", F.lit("")))))).collect()
        for s in {r["source"] for r in got}:
            own = sorted((r for r in got if r["source"] == s), key=lambda r: r["key"])
            target, size = own[0]["target"], own[0]["source_size"]
            whole = target // size if size else 0
            gap, extra, rest = target - whole * size, [], []
            for r in own:
                fits = 0 < r["size"] <= gap
                gap -= r["size"] * fits
                (extra if fits else rest).append(r["size"])
            near = min((n for n in rest if abs(gap - n) < gap), key=lambda n: abs(gap - n), default=0)
            assert sum(r["taken"] for r in own) == whole * size + sum(extra) + near
    x = [r for r in got if r["source"] == "x"]  # one long document among short ones of 20 to 69 words
    assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 35


def test_mix_weights_and_repetition(spark, empty):
    docs = spark.createDataFrame([(i, "a b c", "x" if i < 10 else "y") for i in range(60)], SCHEMA)
    weights = lambda s: s.withColumn("weight", F.when(F.col("source") == "x", 5.0).otherwise(0.0))
    mixed = mix_sources(docs, weights, share=1.0, max_epochs=3.0)
    assert {(r["source"], r["times"]) for r in mixed.collect()} == {("x", 3), ("y", 0)}
    assert repeat_documents(mixed).count() == 30
    assert mix_sources(empty).count() == 0


def test_mix_numbers_rows_of_one_key_without_moving_texts(spark, docs):
    """Whole texts are in no window, unless a stop falls between rows of one doc_id and text."""
    plan = mix_sources(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    rows = [(1, "a b c", "x")] * 7 + [(i, "d e", "x") for i in range(2, 4)] + [(9, "q", None)] * 5
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{SCHEMA}, n int").repartition(3)
    got = mix_sources(table, lambda s: s.withColumn("weight", F.lit(1.0)), share=0.6, max_epochs=1.0).collect()
    assert sorted(r["n"] for r in got) == list(range(len(rows)))
    for source, size in (("x", 25), (None, 5)):
        own = [r for r in got if r["source"] == source]
        target = own[0]["target"]
        assert own[0]["source_size"] == size and abs(sum(r["taken"] for r in own) - target) <= 1.5
    assert {r["times"] for r in got if r["doc_id"] == 1} == {0, 1}


def test_suspects(spark):
    rows = spark.createDataFrame([(i if i else None, f"t{i}") for i in range(2000)], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(500, 600)] + [(None,), (7,), (7,)], "of long")
    got = {r["text"]: r["_suspect"] for r in mark_suspects(rows, "doc_id", ids).collect()}
    wanted = {f"t{i}" for i in [0, 7, *range(500, 600)]}
    assert len(got) == 2000 and all(got[t] for t in wanted)
    assert sum(got.values()) - len(wanted) <= 3
    assert not any(r["_suspect"] for r in mark_suspects(rows, "doc_id", ids.limit(0)).collect())


def test_texts_go_to_python_in_small_batches(spark):
    import pyarrow as pa

    from stancelab.llm.scratch import Scratch
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def rows_of(frames):
        for b in frames:
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64())})

    sizes = spark.range(0, 2500, 1, 1).mapInArrow(rows_of, "n long")
    scratch = Scratch(spark, "test-batches")
    assert [r["n"] for r in scratch.table(sizes, batch_rows=1000).collect()] == [1000, 1000, 500]
    assert spark.conf.get(name) == before
    assert [r["n"] for r in scratch.table(sizes).collect()] == [2500]


def test_near_copies_are_dropped_by_id(spark):
    """Only rows whose id may have a row to drop are joined; repeated and null ids share their fate."""
    import corpus_pipeline
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base, "x"), (2, base + " more", "x"), (2, base, "y"), (3, "quite another text of some words", None),
            (None, base, "z"), (None, "of its own, with five words", "z"), (4, None, "z"), (5, base, "x"), (5, "only this one is kept", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert "bitmap_construct_agg" in out._jdf.queryExecution().optimizedPlan().toString()
    kept = {r["doc_id"] for r in near_duplicates(docs).where("kept").collect()}
    assert kept == {1, 3, None, 4, 5}
    assert as_is([tuple(r) for r in out.collect()]) == as_is([r for r in rows if r[0] in kept])


def test_shards_are_gapless_stable_and_near_even(spark, docs, empty):
    got = shard_documents(docs, 6).collect()
    assert len(got) == len(ROWS) and "spans" in got[0].asDict()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 6) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = {(d, brute.crc(t)): len((t or "").encode()) + 8 for d, t, _ in ROWS}
    assert {(r["doc_id"], r["text_crc32"]): r["size"] for r in got} == text
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({d for d, _, _ in ROWS})
    nulls = spark.createDataFrame([(None, None, None), (None, "x", None), (3, "y", None)], SCHEMA)
    assert sorted(r["slot"] for r in shard_documents(nulls, 1).collect()) == [0, 1, 2]
    assert shard_documents(empty).count() == 0


def test_rendezvous_weights(spark):
    ids = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    count = {r["s"]: r["count"] for r in ids.groupBy(rendezvous(F.col("k"), [1, 3]).alias("s")).count().collect()}
    assert abs(count[1] / 4000 - 0.75) < 0.04
    with pytest.raises(ValueError):
        rendezvous(F.col("k"), [1, 0])


def test_license_scan(spark, docs, empty):
    mit = next(t for i, t in KNOWN if i == "MIT" and t.startswith("MIT"))
    varied = mit.upper().replace("<YEAR> <COPYRIGHT HOLDERS>", "1999 Me").replace(",", " ,").replace("SUBLICENSE", "sub-licence")
    rows = [(1, varied), (1, varied), (2, mit + "\nmore"), (3, "Some text.\nreleased under the  MIT LICENCE\n\nend"),
            (4, None), (5, ""), (6, "?!"), (None, "Copyright 2020 X\nLicensed under CC BY-NC 4.0")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known_digests(spark))
    assert listed(got, "doc_id", "text_license", "line_licenses") == as_is(
        [(1, "MIT", []), (1, "MIT", []), (2, None, []), (3, None, ["MIT"]), (4, None, []), (5, None, []), (6, None, []),
         (None, "CC-BY-NC-4.0", ["CC-BY-NC-4.0"])])
    assert scan_licenses(docs, known_digests(spark)).count() == len(ROWS)
    assert scan_licenses(empty, known_digests(spark)).count() == 0


WHOLE = [(i, t) for i, t in KNOWN if "\n\n" in t]
WIDTHS = (40, 60, 66, 70, 72, 76, 78, 79, 80, 100, 100_000)


def rewrapped(text, width, mark=""):
    return "\n\n".join("\n".join(mark + x for x in textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False))
                       for p in text.split("\n\n"))


def test_whole_licenses_in_any_wrapping(spark):
    owned = [(i, t.replace("<year>", "2011-2020").replace("<copyright holders>", "Acme Inc.").replace("<owner>", "J. R. Doe"))
             for i, t in WHOLE]
    rows = [(i, rewrapped(t, w, mark)) for i, t in WHOLE + owned for w in WIDTHS for mark in ("", "# ", " * ", "// ")]
    rows += [(i, " ".join(t.split())) for i, t in WHOLE + owned]  # one line, its notice among the terms
    table = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["text_license"] for r in scan_licenses(table, known_digests(spark)).collect()}
    assert {n: got[n] for n in got} == {n: i for n, (i, _) in enumerate(rows)}


def test_copyright_notices_go_and_terms_stay(spark):
    mit = "Licensed under the MIT License."
    rows = [
        ("Copyright 2020 X. Licensed under the MIT License.", "MIT"), ("// Copyright (c) 2020 Acme Inc. " + mit, "MIT"),
        ("# Copyright © 1999-2020 A. B. Cee, Dee Ltd. All rights reserved.\n# " + mit, "MIT"),
        ("(c) 2020 X\n" + mit, "MIT"), ("/* © X */\n" + mit + "\n * All Rights Reserved.", "MIT"),
        ("Copyright [yyyy] [name of owner] " + mit, "MIT"), ("copyright notice\n" + mit, None),
        ("COPYRIGHT HOLDERS BE LIABLE\n" + mit, None), ("(c) you must keep this\n" + mit, None),
        ("all rights reserved to the crown by law\n" + mit, None),
        (mit + "\nCopyright 2020 Acme. And more terms.", None), ("In copyright 2020 was a year.\n" + mit, None)]
    table = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["text_license"] for r in scan_licenses(table, known_digests(spark)).collect()}
    assert [got[n] for n in range(len(rows))] == [want for _, want in rows]


def test_whole_texts_of_the_usual_licenses(spark):
    rows = [(i, rewrapped(t, w)) for i, t in licenses.WHOLE for w in (60, 72, 80, 100_000)]
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"} == {i for i, _ in rows}
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1",
             "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    assert {i for i, _ in licenses.DIGESTS} == set(files)
    for i, name in files.items():  # the texts themselves are not in the repository
        path = pathlib.Path("/usr/share/common-licenses") / name
        if path.exists():
            text = path.read_text(encoding="utf-8")
            rows += [(i, text), (i, text.upper()), *((i, rewrapped(text, w)) for w in (60, 72, 80, 100_000))]
            rows += [(None, text + "\nand one more term")]
    table = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["text_license"] for r in scan_licenses(table, known_digests(spark)).collect()}
    assert got == {n: i for n, (i, _) in enumerate(rows)}


def test_license_sql_knows_whole_texts(spark, tmp_path):
    """The SQL and the operator on rewrapped licence texts, which the given tables do not hold."""
    import textwrap

    import duckdb

    from stancelab.llm import oracles
    from stancelab.llm.licenses import UNTITLED
    from stancelab.llm.queries import op5_license_scan
    texts = [t for text in UNTITLED.values() for width in (60, 72, 100) for t in
             ["\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.strip().split("\n\n"))]]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "prose\nReleased under the MIT License.\nmore", "Copyright (c) 2020 X"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = "doc_id, text_digest, text_license, line_licenses"
    want = con.execute(f"SELECT {names} FROM ({oracles.license_sql()}) ORDER BY doc_id").fetchall()
    got = sorted(map(tuple, op5_license_scan(spark, str(tmp_path)).select(*names.split(", ")).collect()))
    assert got == want
    assert [r[2] for r in got[:len(texts)]] == [i for i in UNTITLED for _ in range(3)]
