"""Conversations, vectors, token files and the classifier against brute force."""

import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stancelab.llm.bigru import NO_WORDS, STRIDE, WINDOW, BiGru, read_words, windows
from stancelab.llm.chat import chain, format_conversations, read_turns, unescape
from stancelab.llm.neighbours import KdTree, chi_square_quantile, nearest
from stancelab.llm.tokenfiles import TokenFile, read_tokens, write_file, write_tokens
from stancelab.llm.toxicity import fit, fit_sample, score_documents
from tests.llm import brute

MESSAGES = "tree_id long, node_id long, parent_id long, score double, role string, text string"


def paths_of(spark, rows, **options):
    got = format_conversations(spark.createDataFrame(rows, MESSAGES), **options)
    return {(r["tree_id"], r["path_rank"]): (r["leaf_id"], r["path_score"], [(t["role"], t["text"]) for t in r["turns"]],
                                             r["formatted"], r["segments"])
            for r in got.withColumn("turns", read_turns(F.col("formatted"))).collect()}


def test_reply_trees(spark):
    rows = [(1, 1, None, 1.0, "user", "q"), (1, 2, 1, 2.0, "assistant", "a"), (1, 3, 1, 5.0, "assistant", "b"),
            (1, 4, 3, 0.0, "user", "c"), (1, 5, 2, None, "user", "d"), (1, 5, 2, None, "user", "d"),
            (2, 1, 99, 0.0, None, None), (2, None, 1, 0.0, "user", "lost"),
            (3, 1, 2, 0.0, "user", "x"), (3, 2, 1, 0.0, "user", "y"), (3, 3, 2, 0.0, "user", "below a cycle"),
            (None, 1, None, 0.0, "user", "null tree"), (None, 2, 1, 0.0, "assistant", "")]
    got = paths_of(spark, rows)
    assert {k: v[:3] for k, v in got.items()} == {
        (1, 1): (4, 6.0, [("user", "q"), ("assistant", "b"), ("user", "c")]),
        (1, 2): (5, 3.0, [("user", "q"), ("assistant", "a"), ("user", "d")]),
        (2, 1): (1, 0.0, [("", "")]), (None, 1): (2, 0.0, [("user", "null tree"), ("assistant", "")])}
    assert set(paths_of(spark, rows, branches=1)) == {(1, 1), (2, 1), (None, 1)}
    assert format_conversations(spark.createDataFrame([], MESSAGES)).count() == 0


def test_deep_and_bushy_trees(spark):
    r = random.Random(3)
    deep = [(7, i, i - 1 if i else None, 0.5, "user", str(i)) for i in range(70)]
    bushy = [(8, i, r.randrange(i) if i else None, float(r.randrange(5)), "user", str(i)) for i in range(60)]
    got = paths_of(spark, deep + bushy)
    assert [t for _, t in got[7, 1][2]] == [str(i) for i in range(70)] and got[7, 1][1] == 35.0
    parent = {i: p for _, i, p, *_ in bushy}
    score = {i: s for _, i, _, s, _, _ in bushy}
    want = {}
    for leaf in set(parent) - set(parent.values()):
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = parent[at]
        want[leaf] = (sum(score[i] for i in path), [str(i) for i in path[::-1]])
    order = sorted(want, key=lambda leaf: (-want[leaf][0], leaf))
    for rank, leaf in enumerate(order, 1):
        assert got[8, rank][:2] == (leaf, want[leaf][0]) and [t for _, t in got[8, rank][2]] == want[leaf][1]


def test_template_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\n", "<\\/s>", "</s>\n<s>user\n", "[[INST]", "<<<SYS>>>", "a\nb\\nc", "",
             None, "<|im_end|>\\<", "é ✓ </s", "s>", "x" * 50_000, "$1 \\1"]
    rows = [(1, i, i - 1 if i else None, None, "assistant" if i % 2 else t, t) for i, t in enumerate(texts)]
    _, _, turns, formatted, segments = paths_of(spark, rows)[1, 1]
    assert turns == [("assistant" if i % 2 else t or "", t or "") for i, t in enumerate(texts)]
    assert "".join(s["text"] for s in segments) == formatted and formatted.count("</s>") == len(texts)
    loss = spark.createDataFrame([(s["text"],) for s in segments if s["loss"]], "t string").select(unescape(F.col("t")))
    assert sorted(r[0] for r in loss.collect()) == sorted(t or "" for t in texts[1::2])


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 1, None, None),
            (1, 1, None, None), (None, 3, "assistant", "z"), (None, None, "user", "first"), (2, 5, "assistant", "</s>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit(1.0))
    done = format_conversations(chain(turns, "conv_id", ["turn", "role", "text"]), "conv_id")
    got = {}
    for r in done.withColumn("turns", read_turns(F.col("formatted"))).collect():
        said = "".join(f"{t['role']}\n{t['text']}\n" for t in r["turns"])
        loss = "".join(s["text"] for s in r["segments"] if s["loss"]).replace("<\\/s>", "</s>")
        got[r["conv_id"]] = (len(r["turns"]), brute.sha(said), len(loss), brute.sha(loss))
    assert got == brute.chat(rows)


def vectors(n, dim, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((8, dim)) * 0.6
    return [(i, [float(x) for x in centres[i % 8] + r.standard_normal(dim)]) for i in range(n)]


def test_nearest_recall_and_scores(spark):
    rows = vectors(3000, 24)
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute.neighbours(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got: dict = {}
    for r in nearest(base, base.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = sum(len({v for _, v, _ in got[q]} & {v for _, v in best}) for q, best in want.items())
    assert hit >= 0.9 * 5 * len(want)
    v = {i: np.array(x) for i, x in rows}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i])) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)


def test_nearest_with_several_blocks(spark, monkeypatch):
    import stancelab.llm.neighbours as n
    monkeypatch.setattr(n, "BLOCK", 200)
    monkeypatch.setattr(n, "SAMPLE", 512)
    rows = vectors(1500, 10, seed=2)
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute.neighbours(rows, {i for i, _ in rows if i % 100 == 0}, 4)
    got = {(r["query_id"], r["vec_id"]) for r in nearest(base, base.where("vec_id % 100 = 0"), 4).collect()}
    assert len(got) == 4 * len(want)
    assert sum((q, i) in got for q, best in want.items() for _, i in best) >= 0.9 * 4 * len(want)


def test_nearest_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [1.0, None], 1),
            (5, [inf, 0.0], 1), (50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [1.0, 0.0], 1), (53, [-0.0, 1.0], 1),
            (53, [0.0, 1.0], 1), (54, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (100, [0.0, 0.0], 1)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"])
                 for r in nearest(base, base.where("vec_id % 50 = 0"), 3).collect())
    assert got == [(0, 1, 50, 1.0), (0, 2, 51, 1.0), (0, 3, 52, 1.0), (50, 1, 0, 1.0), (50, 2, 51, 1.0), (50, 3, 52, 1.0)]
    few = nearest(base.where("vec_id IN (0, 53)"), base.where("vec_id = 0"), 3).collect()
    assert [(r["vec_id"], r["score"]) for r in few] == [(53, 0.0)]
    assert nearest(base.limit(0), base, 3).count() == 0 and nearest(base, base.limit(0), 3).count() == 0


def test_kd_tree_and_quantile():
    r = np.random.default_rng(5)
    x = r.standard_normal((500, 3))
    tree = KdTree.fit(x, 16)
    box, far = tree.place(x), tree.distances(x)
    assert np.bincount(box).max() <= 40 and (far[np.arange(500), box] == 0).all()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert all(far[i, b] <= d[i, box == b].min() + 1e-12 for i in range(50) for b in range(16))
    assert abs(chi_square_quantile(0.95, 10) - 18.307) < 1e-3 and abs(chi_square_quantile(0.5, 2) - 1.38629) < 1e-4


def test_token_file_round_trip_and_damage():
    r = np.random.default_rng(1)
    docs = [(i if i % 4 else None, r.integers(0, 50_000, n).astype(np.uint32)) for i, n in enumerate([5, 0, 300, 1, 90, 0, 0, 2000, 7])]
    for frame in (1, 100, 10**6):
        sink = io.BytesIO()
        assert write_file(sink, docs, frame) == (9, sum(len(x) for _, x in docs))
        raw = sink.getvalue()
        t = TokenFile(io.BytesIO(raw), len(raw))
        order = list(range(9))
        random.Random(2).shuffle(order)
        assert all((t[i] == docs[i][1]).all() and len(t[i]) == len(docs[i][1]) for i in order)
    broken = bytearray(raw)
    broken[10] ^= 1
    with pytest.raises(Exception):
        TokenFile(io.BytesIO(bytes(broken)), len(broken))[2]
    broken = bytearray(raw)
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        TokenFile(io.BytesIO(bytes(broken)), len(broken))
    sink = io.BytesIO()
    write_file(sink, [])
    assert len(TokenFile(sink, len(sink.getvalue()))) == 0


def test_words_of_several_runs_are_encoded_by_run():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from stancelab.llm.tokenfiles import Encoder
    path = public.path("word_bpe_49k.json")
    encoder, plain, asked = Encoder(path), Tokenizer.from_file(path), []

    class Whole:
        def encode_batch_fast(self, words, **options):
            asked.extend(words)
            return plain.encode_batch_fast(words, **options)

    encoder._tokenizer = Whole()
    texts = ["Alpha*** beta,### gamma. Delta.", "555-3382 x@y.z (naïve) É.É", "don't 'tis a's. o'&", "", ".", "a.",
             "½. a.\u0301 e\u0301. 日本, ß.ÿ", "a<|endoftext|>b <|endoftext|> <|x|>", "alpha*** zeta%%% 5. 6, ..., a. \ta,\nb."]
    for _ in range(2):
        got = encoder.encode([t.encode() for t in texts])
        assert [list(x) for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(asked) == len(set(asked))
    # letters and ASCII marks are known by themselves; only what the pattern may cut otherwise goes through it whole
    assert not any(w.isascii() and len(w) > 1 and any(c.isalnum() for c in w) for w in asked
                   if "'" not in w and "<|endoftext|>" not in w)
    assert {"don't", "***", "a<|endoftext|>b"} <= set(asked)


def test_written_tokens(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["Hello, World. it's 42!", "", None, "é naïve   x y ﬁ é.", "<|endoftext|> a<|startoftext|>b. C.",
             "don't. 3.14, a.b,c", "A" * 5000 + ".", "the the the. The, THE", "日本語。 ok.", "İ ΑΣ. ß,", "x.\x0b\x0cy.\x85z", "...", ",a ,", "Ⅷ. ½,"]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "again"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("file", F.lit("clash"))
    for by_piece in (True, False):
        files = write_tokens(docs, path, str(tmp_path / str(by_piece)), end_id=2, by_piece=by_piece, frame_ids=8)
        start, want = 0, []
        for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
            want.append((d, start, ids))
            start += len(ids)
        got = sorted(((r["doc_id"], r["start"], r["ids"]) for r in read_tokens(files).collect()), key=lambda r: r[1])
        assert got == want
        assert {r["doc_id"] for r in read_tokens(files, [9, 3]).collect()} == {9, 3}
    none = write_tokens(docs.limit(0), path, str(tmp_path / "none"))
    assert none.count() == 0 and read_tokens(none).count() == 0


def test_windows_cover_and_overlap():
    t = read_words(pa.array(["a " * 100, "", None, "one", "b " * 24, "c " * 25], pa.string()))
    text, first, length = windows(t.bounds)
    for i in range(6):
        n = t.bounds[i + 1] - t.bounds[i]
        seen = {int(p) for f, k in zip(first[text == i], length[text == i]) for p in range(f, f + k)}
        assert seen == set(range(t.bounds[i], t.bounds[i + 1])) and (n > 0) == bool((text == i).any())


def test_gru_gradients():
    t = read_words(pa.array(["the cat sat on a mat", "a dog ran " * 14, "x"]))
    text, first, length = windows(t.bounds)
    first, length = first[[0, 1, -1]], length[[0, 1, -1]]  # no shared words
    model = BiGru(np.unique(t.hash)[:4], np.zeros(4))
    model.p = {k: v.astype(np.float64) * 2 for k, v in model.p.items()}
    args = (t, first, length, np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 1.0]))
    _, grad = model.gradients(*args)
    r = np.random.default_rng(0)
    for name, a in model.p.items():
        flat, g = a.reshape(-1), np.asarray(grad[name]).reshape(-1)
        for i in r.choice(np.flatnonzero(g), min(5, np.count_nonzero(g)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = model.gradients(*args)[0]
            flat[i] = old - 1e-3
            down = model.gradients(*args)[0]
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[i]) < 1e-4 + 0.02 * abs(g[i]), name


def toy(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    texts, toxic = [], []
    for i in range(n):
        words = r.choices(vocabulary, k=r.randint(5, 150))
        bad = i % 4 == 0
        if bad:
            words[r.randrange(len(words))] = r.choice(["Rotten", "vile,", "zorg" + r.choice(["a", "ix", "um", "el"])])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, np.array(toxic)


def test_classifier_held_out(spark):
    texts, toxic = toy(600, 1)
    model = fit(texts, toxic)
    fresh, labels = toy(300, 2)
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(fresh)] + [(900, None, ""), (901, "", ""), (902, "?!", "")],
                                 "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in score_documents(docs, model).collect()}
    right = sum(got[i]["predicted"] == y for i, y in enumerate(labels))
    assert right >= 0.95 * len(labels)
    assert all(got[i]["score"] == NO_WORDS and got[i]["predicted"] == 0 for i in (900, 901, 902))
    assert score_documents(docs.limit(0), model).count() == 0
    clean = [w for t, y in zip(fresh, labels) if not y for w in t.split()]
    long = " ".join((clean * 4)[:30_000] + ["vile"] + (clean * 4)[30_000:60_000])  # found wherever it stands
    assert model.scores(pa.array([long, long.replace("vile", "w3")])).round().tolist() == [1, 0]


def test_fit_sample_keeps_the_held_out_fold_out(spark):
    import zlib
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(None, "x"), (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(None, 1), (3, None), (500, 1), (7, 1)],
                                   "doc_id long, toxic int")
    got = {int(r["text"].split()[1]): r["toxic"] for r in fit_sample(docs, labels).collect()}
    assert got == {i: i % 2 for i in range(150) if zlib.crc32(str(i).encode()) % 5}
    assert fit_sample(docs, labels, rows=5).count() == 10
    assert fit([], np.array([])).scores(pa.array(["word"])).round().tolist() == [0]
    assert fit(["a b"], np.array([1])).scores(pa.array(["word"])).round().tolist() == [1]


def test_scores_are_those_of_a_plain_recurrence():
    """Every window on its own, word by word, in plain loops; a text's score is its worst window's."""
    texts = ["the cat sat", "a dog ran vile " * 15, "x", "é ü " * 13 + "end", ""]
    model = fit(*toy(80, 4))
    model.p["out"] += np.linspace(-1, 1, len(model.p["out"])).astype(np.float32)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    k = len(p["uf"])

    def sigmoid(v):
        return 1 / (1 + np.exp(-v))

    def states(xs, d):
        h, out = np.zeros(k), []
        for x in xs:
            a, g = x @ p["w" + d] + p["c" + d], h @ p["u" + d]
            z, r = sigmoid(a[:k] + g[:k]), sigmoid(a[k:2 * k] + g[k:2 * k])
            h = (1 - z) * np.tanh(a[2 * k:] + r * g[2 * k:]) + z * h
            out.append(h)
        return out

    for text, got in zip(texts, model.scores(pa.array(texts, pa.string()))):
        t = read_words(pa.array([text], pa.string()))
        x = model.inputs(t).astype(np.float64)
        best = None
        for first in range(0, max(1, len(x)), STRIDE):
            own = x[first:first + WINDOW]
            if not len(own):
                continue
            both = [np.concatenate(s) for s in zip(states(own, "f"), states(own[::-1], "b")[::-1])]
            e = np.exp([s @ p["attend"] for s in both])
            logit = (e / e.sum()) @ both @ p["out"] + own[:, 0].sum() * p["past"][0] + p["bias"][0]
            best = logit if best is None else max(best, logit)
            if first + WINDOW >= len(x):
                break
        assert abs(got - (NO_WORDS if best is None else sigmoid(best))) < 1e-4, text


def test_neighbours_among_many_lengths(spark):
    """More lengths than have an index of their own; each is searched whole."""
    from stancelab.llm import neighbours
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(1 + i % (neighbours.LENGTHS + 9)).tolist()) for i in range(400)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in nearest(base, base.where("vec_id % 50 = 0"), k=3).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    for q in range(0, 400, 50):
        v = np.array(rows[q][1])
        best = sorted((-float((np.array(w) * v).sum() / (np.sqrt((np.array(w) ** 2).sum()) * np.sqrt((v * v).sum()))), i)
                      for i, w in rows if i != q and len(w) == len(v))[:3]
        assert [(k, i) for k, i, _ in sorted(got[q])] == [(k, i) for k, (_, i) in enumerate(best, 1)] or \
            np.allclose([s for _, _, s in sorted(got[q])], [-s for s, _ in best])


def test_the_search_verifies_a_part(spark):
    """The stopping test holds before all vectors are looked at, and the share falls as the table grows."""
    from stancelab.llm import neighbours
    r = np.random.default_rng(8)
    shares = []
    for n in (1000, 8000):
        points, seen = r.standard_normal((n, 64)), []
        own = list(range(0, n, n // 50))
        neighbours.search_block(points, [[i] for i in range(n)], points[own], own, np.full(len(own), np.inf), 5,
                                neighbours.projection(64, neighbours.PROJECTIONS),
                                chi_square_quantile(neighbours.CONFIDENCE, neighbours.PROJECTIONS), seen)
        shares.append(seen[0] / len(own) / n)
    assert shares[1] < shares[0] < 0.9
