"""Source divergence, tokenizer alignment and disclosing terms against brute force."""

import random
from functools import reduce

import numpy as np
import public_tokenizers
import pytest

from stancelab.llm import alignment, disclosure, divergence, queries
from tests.conftest import SF_SMALL
from tests.llm import brute

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- source divergence -----------------------------------------------------------------------

USES = "lang string, source string, text string, term string, s long, n long, block long, tile long, v int, p long"


def spoken(n, seed):
    """Rows with shared prefixes of many lengths, nulls, empties, repeated rows and a hot source."""
    rng = random.Random(seed)
    stems = ["a", "ab", "abcd", "abcde", "abcdefgh", "abcdefghi", "é" * 9, "Straße", "x" * 40, "x" * 40 + "y"]
    words = [s + e for s in stems for e in ("", "s", "ing", "ABLE", "é")]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choice(words[: rng.choice([5, 20, 50])]) + rng.choice(["", ".", "1", "_x"])
                        for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "de", None, ""]), rng.choice(["hot", "hot", "s1", "s2", None, ""]), rng.choice([text, text, text, None, ""])))
    return rows + rows[:5] + [("fr", "s1", "zu wenig"), ("fr", "s2", "zu wenig"), ("fr", "s3", None)]


def diverged(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "t", 1, 2, 3, 4, 5, 6) for r in rows], USES.replace("block long, ", "") + ", block long")
    got = divergence.source_divergence(docs, **options)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"),
                          ("value", "bigint"), ("rank", "int")]
    return sorted(map(tuple, got.collect()))


def test_divergence(spark):
    rows = spoken(150, 1)
    assert diverged(spark, rows) == brute.divergence(rows, 10, 10)
    # one source a tile, a few terms a block, and a bitmap that is nearly full
    assert diverged(spark, rows, min_docs=3, top=2, first_level=1, filter_bits=64, block_terms=7, tile_sources=1) == \
        brute.divergence(rows, 3, 2)
    assert diverged(spark, [], min_docs=1) == []
    assert diverged(spark, [(None, None, None)]) == []


def test_long_division(spark):
    n, total = 5_000_000_000_000_000 - 1, 9_000_000_000_000_000
    f = spark.range(1).select(divergence._share(divergence.F.lit(n), divergence.F.lit(total)).alias("p"))
    assert f.first()["p"] == 1 + 10**9 * n // total


def test_prefixes_below_the_threshold_go(spark):
    """A level looks only at terms whose prefix is left."""
    rows = [("en", "s", f"commonest rare{i:04d}abcdefghijkl".translate(str.maketrans("0123456789", "qrstuvwxyz"))) for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    kept = divergence.kept_terms(docs, 10).collect()
    assert [(r["term"], r["n"]) for r in kept] == [("commonest", 40)]


# ---- tokenizer alignment ---------------------------------------------------------------------

ODD = [None, "", " ", "a", "  two  spaces ", "tab\tnew\n line\r\n", "x" * 3000, "é ü ß ñ", "ｆｕｌｌ　ｗｉｄｔｈ 漢字 かな",
       "<|endoftext|> <s> </s> <unk> ▁ ▁▁x", "a b   c d é", "don't I'll 'tis 1,000.5 $x = {y};",
       "\x00 \x7f ﻿ ‍ 👩‍👩‍👧 🇩🇪", "\x1c a \x1d\x1e b", "\u0085 a \u0085b", "a ' s it 's we 'll", "word " * 400]


def test_alignment(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(-i if i else None, t) for i, t in enumerate(ODD)] + docs + docs[:3] + [
        (10**6, " ".join(t for _, t in docs[:60] if t)), (10**6 + 1, "y" * 5000 + " z" * 50)]
    frame = spark.createDataFrame([(*r, 1, True, "x") for r in rows], "doc_id long, text string, at long, same boolean, segment string")
    some = frame.where("doc_id <= 0 OR doc_id IS NULL OR doc_id > 1000000")
    for own, options in ((frame, {}), (frame, {"range_bytes": 500, "segment_bytes": 4000, "block_pairs": 3000}),
                         (some, {"range_bytes": 7, "segment_bytes": 100})):
        want = sorted(brute.aligned([(r["doc_id"], r["text"]) for r in own.collect()], A_PATH, B_PATH), key=str)
        assert sum(r[1] == 0 for r in want) >= 3 and sum(r[5] for r in want) > 0
        got = alignment.align_tokenizers(own.repartition(5), A_PATH, B_PATH, **options)
        assert sorted(map(tuple, got.collect()), key=str) == want, options
    assert alignment.align_tokenizers(frame.limit(0), A_PATH, B_PATH).count() == 0


def test_fragments_are_a_monoid():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size = int(rng.integers(2, 60))
        ends_a, ends_b = (np.unique(np.append(rng.integers(1, size, size // 2 + 1), size)) for _ in "ab")
        a, b = (rng.integers(0, 99, len(e)) for e in (ends_a, ends_b))
        whole = alignment.fragment(a, ends_a, b, ends_b)
        cuts = np.unique(rng.integers(0, size, 5))
        parts = [alignment.fragment(a[x], ends_a[x], b[y], ends_b[y]) for x, y in (
            [(ends_a > lo) & (ends_a <= hi), (ends_b > lo) & (ends_b <= hi)]
            for lo, hi in zip([0, *cuts], [*cuts, size]))]
        assert reduce(alignment.compose, parts, alignment.EMPTY) == whole
        assert reduce(lambda g, f: alignment.compose(f, g), reversed(parts), alignment.EMPTY) == whole
        k = len(parts) // 2
        left, right = (reduce(alignment.compose, p, alignment.EMPTY) for p in (parts[:k], parts[k:]))
        assert alignment.compose(left, right) == whole
        assert alignment.groups_of(whole).count(b"|") == len(whole.links) // 8 == len(np.intersect1d(ends_a, ends_b))


def test_words_are_encoded_as_in_the_text():
    aligner = alignment.Aligner(A_PATH, B_PATH)
    assert aligner._by_word
    for text in ODD[2:]:
        got = aligner.encode([text])[0]
        whole = aligner._a.encode(" " + text, add_special_tokens=False).ids, aligner._b.encode(text)
        assert got is None or tuple(x.tolist() for x in got) == whole


# ---- personal data ---------------------------------------------------------------------------

PIECES = ["a@b.c", "x.y+z@mail-1.example.com", "@", "a@b", "a@b.c@d.e", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8.9", "0001.2.3.4",
          "00000000000000000000007.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+49 30 1234567 ", "+1(", "1", "é",
          " ", "-", "a", "..", "+", "12345678901234567890", "(", "%", "漢", "\n"]


def test_base_spans():
    rng = random.Random(5)
    for n in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))
        got = [(disclosure.KINDS[k], len(text.encode()[:s].decode()), len(text.encode()[:e].decode()))
               for k, s, e in disclosure.base_spans(text.encode())]
        assert got == brute.personal(text), text


@pytest.mark.parametrize("piece", ["1", "a", "1 ", "+1", "a@", "1.", "@", "a.b@", "+1 ", "1.2.3.4 "])
def test_base_spans_take_linear_time(piece):
    disclosure.base_spans(piece.encode() * 300_000)


def told(seed):
    """A corpus in which two names stand beside one address, in changing words, and copies of a passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "ü", "1234"]

    def some(n):
        return " ".join(rng.choice(words) for _ in range(n))

    texts = [some(rng.randrange(40)) for _ in range(150)]
    texts += [f"{some(8)} Zorblatt {some(2)} zorb@x.example {some(5)} no77 {some(3)}" for _ in range(8)]
    texts += [f"{some(8)} ZORBLATT {some(20)}" for _ in range(2)]
    texts += [f"é {some(4)} no77 {some(3)}", "", "10.0.0.1", "+1 (743) 555-3824, card 4111 1111 1111 1111, Zorblatt@home.example"]
    return texts + ["singular phrase beside 10.1.2.3 is copied here"] * 20


def test_disclosing_terms_are_found(spark):
    texts = told(1)
    for options in ((16, 3, 0.85, 0.99), (3, 2, 0.7, 0.95), (16, 3, 0.95, 0.99)):
        actions, want = brute.disclosed(texts, *options)
        rows = [(i, t, "s", 1, 2, "h") for i, t in enumerate(texts)] + [(None, None, "s", 1, 2, "h")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, term int, h int, hits string").repartition(4)
        # the null text is one more document
        actions, want = brute.disclosed([*texts, ""], *options)
        for block in (1 << 20, 5):
            got = {r["doc_id"]: r for r in disclosure.sanitise(docs, *options, block_terms=block).collect()}
            assert [[tuple(s) for s in got[i]["spans"]] for i in range(len(texts))] == want[:-1]
            assert got[None]["spans"] == [] and got[None]["text"] == ""
        if options == (16, 3, 0.85, 0.99):
            assert actions == {"zorblatt": "generalise", "no77": "generalise"}
            assert "[EMAIL]" in got[150]["text"] and "orblatt" not in got[150]["text"] and "no77" not in got[150]["text"]
            assert got[len(texts) - 1]["text"] == "singular phrase beside [IP] is copied here"
    assert disclosure.sanitise(docs.limit(0)).count() == 0


def test_query_lists_spans(spark):
    """op13's columns on the small table are those of the base patterns."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op13_personal_data(spark, SF_SMALL).collect()}
    for doc_id, text in docs:
        spans = brute.personal(text or "")
        assert [got[doc_id][f"n_{k}"] for k in brute.KIND_PATTERNS] == [sum(s[0] == k for s in spans) for k in brute.KIND_PATTERNS]
        assert got[doc_id]["base_sha256"] == brute.sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
    terms = brute.disclosed([t or "" for _, t in docs], 16, 3, 0.95, 0.99)[1]
    assert [got[d]["spans"] for d, _ in docs] == [",".join(f"{k}:{s}:{e}" for k, s, e, _ in own) for own in terms]


# ---- columns that are only carried along -----------------------------------------------------

INTERNAL = ["size", "score", "predicted", "_carried", "_kept", "_blk", "_val", "_in_blk", "_scores", "_source", "_key", "_nth", "_whole",
            "_rest", "_from", "_rounds", "_of", "_pick_key", "_pick_nth", "_copy", "k1", "k2", "_k1", "_k2", "ranges", "runs", "text2", "spans",
            "items", "n_words", "n_hit", "n_removed", "kept_text", "target", "times", "taken", "shard", "slot", "law", "grown_shard",
            "text_crc32", "source_size", "block", "hits", "cls", "root", "n", "a", "b", "x.y", "with blank"]


def test_clashing_columns_are_kept(spark, tmp_path):
    """Every internal and result name as a further column: nothing crashes, nothing else changes."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from stancelab.llm.decontam import decontaminate, find_overlaps
    from stancelab.llm.mixing import mix_sources, repeat_documents
    from stancelab.llm.neardup import near_duplicates
    from stancelab.llm.shards import shard_documents
    from stancelab.llm.substrings import remove_repeats
    words = " ".join(f"w{i % 17}x{i}" for i in range(60))
    rows = [(i, (words if i % 3 else f"only {i} here"), f"s{i % 3}") for i in range(12)] + [(None, None, None), (3, "", "s1"), (5, words, "s2")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = plain.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in INTERNAL])
    bench = spark.createDataFrame([("t1", " ".join(words.split()[5:25])), (None, "only 3 here"), ("t2", None)], "item_id string, text string")
    operators = {
        "shard": (shard_documents, ["size", "text_crc32", "law", "shard", "grown_shard", "slot"]),
        "mix": (mix_sources, ["size", "source_size", "target", "times", "taken"]),
        "repeats": (remove_repeats, ["n_words", "n_removed", "spans", "kept_text"]),
        "overlaps": (lambda d: find_overlaps(d, bench), ["n_words", "n_hit", "spans", "items"]),
        "cut": (lambda d: decontaminate(d, bench), []),
        "near": (near_duplicates, None),
        "copies": (lambda d: repeat_documents(mix_sources(d)), ["size", "source_size", "target", "times", "taken"]),
    }
    for name, (run, results) in operators.items():
        want, got = run(plain), run(extra)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), name
        if results is not None:
            carried = [c for c in INTERNAL if c in got.columns and c not in results]
            assert set(carried) | set(results) >= set(INTERNAL) - {"spans", "items", "n_hit", "n_words"}, name
            for r in got.collect():
                assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for c in carried), (name, r)
    sf = str(tmp_path)
    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:  # the first one's labels say nothing here
        out = stage(spark, extra, sf)
        assert out.columns == extra.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for c in INTERNAL), name
        assert stage(spark, extra.limit(0), sf).count() == 0
    toxicity = corpus_pipeline.STAGES[0][1](spark, extra, sf)
    assert toxicity.columns == extra.columns and all(r["score"].startswith("score:") for r in toxicity.collect())
    sharded = corpus_pipeline.STAGES[4][1](spark, extra, sf)
    assert sharded.count() == len(rows) and corpus_pipeline.STAGES[4][1](spark, extra.limit(0), sf).count() == 0
