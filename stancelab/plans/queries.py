"""Registered queries on the driver's tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each query maps one or more operators of the study onto the TPC-H-like and text
tables (see README for the mapping).  Doubles are rounded to 6 places and counts
cast to BIGINT so results compare with the SQL oracle in ``oracle_sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..functions.lists import split_list
from ..functions.text import first_phrase_label
from ..landing import Landing
from ..operators import axis as ax
from ..operators import charts as ch
from ..operators import checks as ck
from ..operators import kmeans as km
from ..operators import slices as sl
from ..operators import forecast as fc
from ..operators import ordering as od
from ..operators import prompts as pr
from ..operators import text as tx
from ..operators import significance as sig
from ..operators.effects import EFFECT_COLUMNS, assign_topic, coefficient_table, two_group_effect
from ..sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def rounded_effect(df: DataFrame, keys: list[str], extra: list[str] = ()) -> DataFrame:
    out = [F.col(k) for k in keys] + [F.col(e) for e in extra]
    for c in EFFECT_COLUMNS:
        out.append(r6(c).alias(c) if c in ("coef", "se", "ci_low", "ci_high") else F.col(c))
    return df.select(*out)


# ---------------------------------------------------------------- effects

def effect_by_wording_raw(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem x part: effect of a returned line (x) on extended price (y) per (type, brand).

    The join is left to the planner: AQE broadcasts ``part`` while it is small and
    falls back to a shuffled join (with skew splitting) when it is not; the
    aggregate is partial-then-final either way.
    """
    li = read_table(spark, sf, "lineitem", ["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber",
                                             "l_returnflag", "l_extendedprice"])
    pt = read_table(spark, sf, "part", ["p_partkey", "p_type", "p_brand", "p_name"])
    joined = li.join(pt, li.l_partkey == pt.p_partkey)
    x = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag").isNotNull(), 0)
    # (orderkey, linenumber) repeats in this data; with part and supplier keys the order is total
    return two_group_effect(joined, ["p_type", "p_brand"], x, "l_extendedprice", first_attrs=["p_name"],
                            first_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def effect_by_wording(spark: SparkSession, sf: str) -> DataFrame:
    eff = effect_by_wording_raw(spark, sf).withColumnRenamed("p_name", "first_part_name")
    return rounded_effect(eff, ["p_type", "p_brand"], ["first_part_name"])


def effect_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """documents x labels: effect of toxic (x) on n_chars (y) per (lang, source): mostly undefined."""
    docs = read_table(spark, sf, "documents", ["doc_id", "lang", "source", "n_chars"])
    labels = read_table(spark, sf, "labels", ["doc_id", "toxic"])
    eff = two_group_effect(docs.join(labels, "doc_id"), ["lang", "source"], "toxic", "n_chars",
                           first_attrs=["doc_id"], first_by=["doc_id"])
    return rounded_effect(eff.withColumnRenamed("doc_id", "first_doc_id"), ["lang", "source"],
                          ["first_doc_id"])


def rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------ contingency and tests

def _contingency(spark: SparkSession, sf: str) -> DataFrame:
    """events: domain = user_id % 5, category = event_type, liberal prime = odd event_id."""
    ev = read_table(spark, sf, "events", ["user_id", "event_type", "event_id"]).where(
        F.col("event_type").isNotNull())
    ev = ev.select((F.col("user_id") % 5).cast("long").alias("domain"),
                   F.col("event_type").alias("category"), (F.col("event_id") % 2).alias("prime"))
    return sig.contingency(ev, ["domain", "category"], "prime")


def theme_contingency(spark: SparkSession, sf: str) -> DataFrame:
    return _contingency(spark, sf)


def _two_proportion(spark: SparkSession, sf: str) -> DataFrame:
    counts = _contingency(spark, sf)
    comps = sig.comparisons_vs_reference(counts, "domain", "category", F.lit("view"))
    return sig.two_proportion_tests(counts, comps)


def two_proportion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_two_proportion(spark, sf), list(sig.TEST_COLUMNS))


def _bar_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sig.tests_to_bars(_two_proportion(spark, sf), order=["comparison"])


def bar_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_bar_counts(spark, sf), ["liberal_share", "p_value_greater"])


def bar_segments(spark: SparkSession, sf: str) -> DataFrame:
    group = F.concat(F.lit("fig"), (F.col("domain") / 2).cast("long").cast("string"))
    seg = sig.bar_segments(_bar_counts(spark, sf), group)
    return rounded(seg, ["liberal_label_y", "conservative_label_y", "liberal_share", "conservative_share",
                         "star_y", "y_limit", "p_value_greater"])


def bar_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Where each bar stands and what is written on it: place, labels and segment texts."""
    tests = _two_proportion(spark, sf)
    # a longer name, so that labels have something to wrap; one category has a label of its own
    told = tests.withColumn("comparison", F.regexp_replace("comparison", "(.*)_vs_(.*)", "$1_share_of_all_events_vs_$2"))
    bars = sig.tests_to_bars(told, order=["comparison"], with_position=True)
    return sig.bar_segments(bars, labels={"view": "Views\nonly"}, titles={3: "Third domain"}).select(
        "domain", "category", "x_pos", "category_label", "panel_label", "liberal_text", "conservative_text")


def binomial_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Per language: exact P(X >= #quality docs) under a fair coin over labelled docs."""
    docs = read_table(spark, sf, "documents", ["doc_id", "lang"]).where(F.col("lang").isNotNull())
    labels = read_table(spark, sf, "labels", ["doc_id", "quality"])
    counts = docs.join(labels, "doc_id").groupBy("lang").agg(
        F.count_if(F.col("quality") == 1).cast("long").alias("correct"),
        F.count(F.lit(1)).cast("long").alias("total"))
    return rounded(sig.binomial_test(counts), ["p_value_greater"])


# ------------------------------------------------------------- forecasts

# Fixed parameters of the driver-table mapping: part type plays the issue (with its
# reverse code), brand plays the keyword, and two brands carry keyword overrides.
FORECAST_BANK = [("ECONOMY", 0), ("LARGE", 1), ("MEDIUM", 0), ("PROMO", 1), ("SMALL", None), ("STANDARD", 0)]
FORECAST_OVERRIDES = {"brand#7": "conservative", "brand#13": "liberal"}


def _forecast(spark: SparkSession, sf: str) -> DataFrame:
    bank = spark.createDataFrame(FORECAST_BANK, "p_type string, reverse_code int")
    coefs = effect_by_wording_raw(spark, sf)
    return fc.forecast_table(coefs, bank, issue="p_type", keyword="p_brand", overrides=FORECAST_OVERRIDES)


def forecast_verdict(spark: SparkSession, sf: str) -> DataFrame:
    f = _forecast(spark, sf)
    return f.select("p_type", "p_brand", r6("coef").alias("coef"), "direction",
                    "expected_direction", "derived_forecast_result")


def forecast_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fc.verdict_counts(_forecast(spark, sf))


def forecast_tests(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fc.forecast_tests(_forecast(spark, sf), ["p_type"]), ["p_value_greater"])


def forecast_check(spark: SparkSession, sf: str) -> DataFrame:
    return fc.count_check(fc.verdict_counts(_forecast(spark, sf)))


# ----------------------------------------------------------------- panels

# Fixed parameters of the panel mapping: part types grouped into two figures, with
# display labels for two of them (the rest fall back to the title-cased type).
PANEL_TOPICS = {"size": ["ECONOMY", "LARGE", "MEDIUM", "SMALL"], "line": ["PROMO", "STANDARD"]}
PANEL_LABELS = {"ECONOMY": "Economy parts", "LARGE": "Large parts"}


def coef_panels(spark: SparkSession, sf: str) -> DataFrame:
    """G1 on the flagship table: figure = topic of the part type, panel = type, x = brand."""
    eff = effect_by_wording_raw(spark, sf)
    eff = assign_topic(eff, PANEL_TOPICS, key="p_type", name="topic_group")
    eff = eff.withColumn("label_1", F.concat(F.lower(F.split("p_type", " ").getItem(0)), F.lit(" returned"))) \
             .withColumn("label_2", F.lit("kept"))
    panels = ch.coefficient_panels(eff, "topic_group", ["p_type"], ["p_brand"],
                                   ch.display_label("p_type", PANEL_LABELS))
    out = panels.select("topic_group", F.col("panel_no").cast("long").alias("panel_no"), "p_type",
                        F.col("x_pos").cast("long").alias("x_pos"), "p_brand", "coef", "ci_low", "ci_high",
                        "err_low", "err_high", "direction", "y_min", "y_max", "mixed_axes", "panel_label")
    return rounded(out, ["coef", "ci_low", "ci_high", "err_low", "err_high", "y_min", "y_max"])


# ------------------------------------------------- prompt banks and grid

def part_bank(spark: SparkSession, sf: str) -> DataFrame:
    """A raw prompt bank derived from ``part``, so it grows with the data: one issue per part,
    its brand and lower-cased type as a ragged keyword list (spelled ``None`` when
    p_size % 10 = 0), ending ids p_size % 4 and p_size % 4 + 3 (id 6 has no template)
    and 0, 1, 2 or 4 axis labels."""
    part = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    labels = F.array(F.lit(""), F.lit("good"), F.lit(" good , bad "), F.lit("good,bad, safe ,dangerous"))
    r = F.col("p_size") % 4
    return part.select(
        F.col("p_partkey").alias("issue_no"),
        F.concat(F.lit("What do you think about "), F.col("p_name"), F.lit("?")).alias("prompt"),
        F.when(F.col("p_size") % 10 == 0, F.lit("None"))
         .otherwise(F.concat(F.col("p_brand"), F.lit(" , ,"), F.lower("p_type"))).alias("keywords"),
        F.array_join(F.transform(F.sequence(r, r + 5, F.lit(3)), lambda x: x.cast("string")), " , ").alias("endings"),
        F.element_at(labels, (r + 1).cast("int")).alias("labels"),
    )


def list_normalise(spark: SparkSession, sf: str) -> DataFrame:
    bank = pr.normalise_bank(part_bank(spark, sf), "part")
    return bank.select("issue_no", "keywords", "endings", "labels",
                       *[F.size(split_list(c)).cast("long").alias(f"n_{c}") for c in pr.LIST_COLUMNS])


def bank_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """A whole bank from a file whose header has blanks and a byte-order mark; the optional
    columns it lacks come back as NULL (-1 here)."""
    raw = part_bank(spark, sf).withColumnsRenamed({"issue_no": "\ufeff issue_no ", "prompt": " prompt"})
    bank = pr.normalise_bank(raw, "part")
    return bank.withColumns({c: F.coalesce(c, F.lit(-1)) for c in pr.OPTIONAL_COLUMNS}).select(*pr.BANK_COLUMNS)


def noted_checks(spark: SparkSession, sf: str) -> DataFrame:
    return ck.with_note(shape_checks(spark, sf))


def prompt_grid(spark: SparkSession, sf: str) -> DataFrame:
    return pr.prompt_grid(part_bank(spark, sf), pr.templates_frame(spark), pr.COVID_INTROS)


def grid_unknown_templates(spark: SparkSession, sf: str) -> DataFrame:
    return pr.unknown_templates(part_bank(spark, sf), pr.templates_frame(spark))


def axis_plan(spark: SparkSession, sf: str) -> DataFrame:
    return pr.axis_plan(part_bank(spark, sf))


# ------------------------------------------------------------------ text

# Fixed parameters of the driver mapping: ordered phrase rules that overlap on purpose.
DOC_RULES = (("token =", "token assignment"), ("License", "license line"), ("@", "e-mail"),
             ("license", "license line (lower case)"))


def ending_class(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    return docs.select("doc_id", first_phrase_label("text", DOC_RULES).alias("end_type"))


def secret_hits(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    return tx.pattern_hits(docs, "text", ["doc_id"])


def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return tx.pattern_summary(secret_hits(spark, sf))


def labelling_prompts(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents", ["doc_id", "lang", "text"]).where(F.col("lang").isNotNull())
    return tx.labelling_prompts(docs, "lang", "text", ["doc_id"], k=5)


def coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem x part in the shape of the response table: a shipped line (status F) is a named
    prime, the part's size the issue, the line's number the question, the brand the keyword."""
    li = read_table(spark, sf, "lineitem", ["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_linestatus",
                                            "l_returnflag", "l_extendedprice"])
    pt = read_table(spark, sf, "part", ["p_partkey", "p_type", "p_brand", "p_size"])
    named = F.col("l_linestatus") == "F"
    responses = li.join(pt, li.l_partkey == pt.p_partkey).select(
        named.cast("int").alias("named_prime"), F.col("p_size").alias("issue_no"),
        F.when(F.col("p_size") == 13, F.lit(float("nan"))).otherwise(F.col("p_size") + 0.1).alias("issue_no_key"),
        F.col("l_linenumber").alias("question_no"), F.col("p_brand").alias("keyword"), F.col("p_type").alias("ending"),
        F.concat(F.lit("about "), F.lower("p_type")).alias("end_type"),
        F.concat("p_brand", F.lit(" , "), F.lower("p_type"), F.lit(",x")).alias("labels"),
        (F.col("l_returnflag") == "R").cast("int").alias("liberal"), F.col("l_extendedprice").alias("proj"),
        F.col("l_orderkey").alias("prompt_no"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("completion_no"))
    return rounded_effect(coefficient_table(responses), ["issue_no_key", "question_no"],
                          ["issue_no", "keyword", "ending", "end_type", "label_1", "label_2"])


def justification_prompts_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first 25 prompts in (conversation, turn) order: the operator's limit."""
    conv = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    said = conv.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("prompt_no"), F.col("turn").alias("completion_no"),
        F.lit("Why?").alias("full_prompt"), F.col("text").alias("completion"))
    return pr.justification_prompts(said, limit=25)


def justification_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn followed by the next assistant turn: prompt ' ' completion '. This is because'."""
    conv = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    user = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("full_prompt"))
    reply = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    return user.join(reply, ["conv_id", "turn"]).select(
        "conv_id", "turn", pr.justification_prompt("full_prompt", "completion").alias("justification_prompt"))


# ----------------------------------------------------------- ranks and checks

def first_seen_rank(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events", ["event_id", "event_type"])
    return od.first_seen_rank(ev, "event_type", "event_id").select(
        "event_id", "event_type", F.col("first_seen_rank").cast("long").alias("first_seen_rank"))


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    conv = read_table(spark, sf, "conversations", ["conv_id", "turn", "role"])
    ev = read_table(spark, sf, "events", ["user_id", "event_type", "ts"])
    a = ck.summary_counts(conv, "conversations", {"prompts": "conv_id", "questions": "turn", "issues": "role"})
    b = ck.summary_counts(ev.withColumn("day", F.to_date("ts")), "events",
                          {"prompts": "user_id", "questions": "event_type", "issues": "day"})
    return a.unionByName(b)


def summary_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _summaries(spark, sf)


def shape_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Data-derived shape checks: conversation turns are contiguous from 0 and ids are
    dense; every event id is unique."""
    conv = read_table(spark, sf, "conversations", ["conv_id", "turn"])
    per_conv = conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("c"), F.max("turn").alias("m"))
    cc = per_conv.agg(F.sum("c").cast("long").alias("rows"), F.count(F.lit(1)).cast("long").alias("prompts"),
                      F.sum("c").cast("long").alias("questions"),
                      F.sum(F.col("m") + 1).cast("long").alias("e_rows"),
                      (F.max("conv_id") + 1).cast("long").alias("e_prompts"))
    cc = cc.withColumn("dataset", F.lit("conversations"))
    c_check = ck.shape_check(cc, {"rows": F.col("e_rows"), "prompts": F.col("e_prompts"),
                                  "questions": F.col("e_rows")})
    ev = read_table(spark, sf, "events", ["event_id", "user_id", "event_type"])
    ec = ck.distinct_counts(ev, {"prompts": "user_id", "questions": "event_type", "e_rows": "event_id"},
                            {"rows": F.count(F.lit(1)), "e_prompts": F.max("user_id") + 1}).withColumn("dataset", F.lit("events"))
    e_check = ck.shape_check(ec, {"rows": F.col("e_rows"), "prompts": F.col("e_prompts"),
                                  "questions": F.col("questions")})
    return c_check.unionByName(e_check)


def label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents", ["doc_id"])
    labels = read_table(spark, sf, "labels", ["doc_id"])
    return ck.missing_keys(docs, labels, ["doc_id"])


# ------------------------------------------------------------ vectors (P12 P13 P14, Entry 1)

def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])


def _projected(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector scored on the axis from vector 0 (positive) to vector 1 (negative)."""
    emb = _embeddings(spark, sf)
    pos = ax.single_vector(emb.where(F.col("vec_id") == 0), "embedding")
    neg = ax.single_vector(emb.where(F.col("vec_id") == 1), "embedding")
    return ax.project(emb, "embedding", pos, neg)


def axis_projection(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf).select("vec_id", "label", r6("proj").alias("proj"), "proj_b")


def projection_sign(spark: SparkSession, sf: str) -> DataFrame:
    return _projected(spark, sf).groupBy("label").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.count_if(F.col("proj_b") == 1).cast("long").alias("n_positive"),
        r6(F.avg("proj")).alias("mean_proj"))


def axis_projection_means(spark: SparkSession, sf: str) -> DataFrame:
    """Variant: anchors are the mean vectors of label 0 (positive) and label 1 (negative)."""
    emb = _embeddings(spark, sf)
    means = ax.mean_vector_by(emb.where(F.col("label").isin(0, 1)), ["label"], "embedding")
    pos = means.where(F.col("label") == 0).select("mean_vec").scalar()
    neg = means.where(F.col("label") == 1).select("mean_vec").scalar()
    return ax.project(emb, "embedding", pos, neg).select("vec_id", "label", r6("proj").alias("proj"), "proj_b")


def effect_on_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Entry 1 end to end: projection as the outcome, odd vec_id as the prime, label as wording."""
    proj = _projected(spark, sf).withColumn("x", F.col("vec_id") % 2)
    eff = two_group_effect(proj, ["label"], "x", "proj")
    return rounded_effect(eff, ["label"])


# ------------------------------------------------ slices

def _archive(spark: SparkSession, sf: str) -> DataFrame:
    """Where each vector lies in its archive, with its length and first component: what the manifest and
    the pairing ask for.  The vectors themselves stay out of the numbering's shuffle.

    Embeddings laid out as two archives of contiguous slices: slice = (label, 1, pos|neg by
    vec_id parity), archive = part1/part2 by label parity, rows sorted by (slice, vec_id)."""
    emb = _embeddings(spark, sf).select(
        F.col("label").alias("prompt_no"), F.lit(1).alias("connector"),
        F.when(F.col("vec_id") % 2 == 0, "pos").otherwise("neg").alias("sentiment"),
        F.concat(F.lit("part"), (F.col("label") % 2 + 1).cast("string")).alias("archive_file"),
        "vec_id", F.size("embedding").alias("dimension"), F.get("embedding", 0).alias("x0"))
    block = F.struct("prompt_no", "sentiment", F.floor(F.col("vec_id") / 65536))
    numbered = od.row_index(emb, ["prompt_no", "sentiment", "vec_id"], "row_no", partition=["archive_file"], block=block)
    return Landing(spark, "archive").table(numbered, "numbered")  # read by the manifest and by its slices


def _manifest(archive: DataFrame) -> DataFrame:
    return sl.slice_manifest(archive, dimension=F.col("dimension"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as justification texts: slice (doc_id % 10, 1, pos|neg by (doc_id div 10) parity)."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    return docs.select(
        (F.col("doc_id") % 10).cast("int").alias("prompt_no"), F.lit(1).alias("connector"),
        F.when((F.floor(F.col("doc_id") / 10) % 2) == 0, "pos").otherwise("neg").alias("sentiment"),
        F.col("doc_id").alias("justification_no"), F.col("text").alias("justification"))


def slice_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(_archive(spark, sf))


def slice_read(spark: SparkSession, sf: str) -> DataFrame:
    archive = _archive(spark, sf)
    vectors = sl.read_slices(archive, _manifest(archive))
    texts = sl.texts_by_position(_texts(spark, sf))
    return sl.pair_texts(vectors, texts).select(
        *sl.SLICE_KEYS, F.col("position").cast("long").alias("position"), "vec_id",
        F.col("justification_no").alias("doc_id"))


def stored_slice_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``slice_read`` from stored tables: vectors and texts landed bucketed by slice and position, then paired
    without a shuffle."""
    archive = _archive(spark, sf)
    landing = Landing(spark, "stored")
    tag = landing.root.rsplit("-", 1)[1]
    vectors = sl.read_slices(archive, _manifest(archive)).select(*sl.SLICE_KEYS, "position", "vec_id")
    texts = sl.texts_by_position(_texts(spark, sf)).select(*sl.SLICE_KEYS, "position", F.col("justification_no").alias("doc_id"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = [sl.store_by_position(df, f"stancelab_{name}_{tag}", f"{landing.root}/{name}", buckets)
              for name, df in (("vectors", vectors), ("texts", texts))]
    return sl.pair_texts(*stored).where(~F.col("missing_text")).select(
        *sl.SLICE_KEYS, F.col("position").cast("long").alias("position"), "vec_id", "doc_id")


def manifest_integrity(spark: SparkSession, sf: str) -> DataFrame:
    archive = _archive(spark, sf)
    manifest = _manifest(archive)
    return sl.manifest_integrity(manifest, _texts(spark, sf), vectors=sl.read_slices(archive, manifest))


def pair_missing_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Only texts labelled toxic are justifications here, so most vectors have none."""
    archive = _archive(spark, sf)
    vectors = sl.read_slices(archive, _manifest(archive))
    toxic = read_table(spark, sf, "labels", ["doc_id", "toxic"]).where(F.col("toxic") == 1).select(
        F.col("doc_id").alias("justification_no"))
    texts = sl.texts_by_position(_texts(spark, sf).join(toxic, "justification_no"))
    return sl.pair_texts(vectors, texts).select(
        *sl.SLICE_KEYS, F.col("position").cast("long").alias("position"), "vec_id",
        F.coalesce("justification_no", F.lit(-1)).alias("doc_id"), "missing_text")


def short_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest promises vectors that the archive has lost: whole slices (label 9) and single ones."""
    archive = _archive(spark, sf)
    manifest = _manifest(archive)
    left = archive.where((F.col("prompt_no") != 9) & (F.col("x0") < 0.5))
    found = sl.manifest_integrity(manifest, _texts(spark, sf), vectors=sl.read_slices(left, manifest))
    whole = ~F.col("status").isin("missing_slice", "short_slice")
    return found.select(*sl.SLICE_KEYS, "n_vectors", "n_read", F.when(whole, "whole").otherwise(F.col("status")).alias("status"))


def null_key_index(spark: SparkSession, sf: str) -> DataFrame:
    """Numbering with NULLs in the partition key (views) and in the order key (clicks)."""
    ev = read_table(spark, sf, "events", ["event_id", "user_id", "event_type"])
    ev = ev.withColumns({"k": F.nullif("event_type", F.lit("view")),
                         "o": F.when(F.col("event_type") != "click", F.col("user_id"))})
    return od.row_index(ev, ["o", "event_id"], "row_no", partition=["k"], block=od.default_block("o", 1024)).select(
        "event_id", "event_type", "row_no")


def missing_reference(spark: SparkSession, sf: str) -> DataFrame:
    """One domain has no rows in the reference category; its comparisons stay."""
    ev = read_table(spark, sf, "events", ["event_id", "user_id", "event_type"])
    ev = ev.withColumns({"domain": F.col("user_id") % 5, "category": F.col("event_type"), "prime": F.col("event_id") % 2})
    counts = sig.contingency(ev.where((F.col("category") != "view") | (F.col("domain") != 3)), ["domain", "category"], "prime")
    pairs = sig.comparisons_vs_reference(counts, "domain", "category", F.lit("view"))
    tests = sig.two_proportion_tests(counts, pairs)
    return tests.select("domain", "comparison", "lib_right", "con_right", "lib_left", "con_left",
                        r6("p_right").alias("p_right"), r6("p_left").alias("p_left"))


# ------------------------------------------------------------------- clustering

def _points(spark: SparkSession, sf: str) -> DataFrame:
    emb = _embeddings(spark, sf)
    return emb.select((F.col("label") % 3).alias("slice"), F.col("vec_id").alias("point_id"),
                      F.col("embedding").cast("array<double>").alias("vec"))


def _assign_step(spark: SparkSession, sf: str) -> DataFrame:
    """One assignment step from fixed starts: the 4 smallest point ids of each slice."""
    pts = _points(spark, sf)
    # ids alone are ranked; at most 4 vectors a slice are then fetched through a broadcast of as many ids
    ids = od.first_k(pts.select("slice", "point_id"), 4, ["point_id"], ["slice"], name="rank")
    starts = pts.join(F.broadcast(ids), ["slice", "point_id"])
    cents = starts.groupBy("slice").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec"))), lambda s: s.getField("vec"))
        .alias("cents"))
    return km.assign(pts, cents, ["slice"])


def kmeans_assign_step(spark: SparkSession, sf: str) -> DataFrame:
    return _assign_step(spark, sf).select("slice", F.col("point_id").alias("vec_id"), "cluster",
                                          r6("sq_dist").alias("sq_dist"))


def cluster_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality metrics of the one-step assignment (exact; checked against brute-force pairs)."""
    m = km.quality_metrics(_assign_step(spark, sf), ["slice"])
    return rounded(m, ["inertia", "silhouette_sqeuclidean", "calinski_harabasz", "davies_bouldin"])


def _kmeans(spark: SparkSession, sf: str):
    return km.kmeans(_points(spark, sf), ["slice"], k=4, restarts=10, seed=42)


def kmeans_grouped(spark: SparkSession, sf: str) -> DataFrame:
    """The converged clustering, by what holds of any: per slice the points, those not in their
    nearest cluster (none), the centres further from their members' mean than the tolerance allows
    (none), restarts that did not converge (none), and whether it is no worse than one step from
    fixed starts."""
    assigned, cents, inertia = _kmeans(spark, sf)
    pts = _points(spark, sf)
    told = assigned.select("slice", "point_id", F.col("cluster").alias("own"), F.col("sq_dist").alias("own_dist"))
    again = km.assign(pts, cents.select("slice", "cents"), ["slice"]).join(told, ["slice", "point_id"], "left")
    per = again.groupBy("slice").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.count_if(F.col("own").isNull() | (F.col("own_dist") > F.col("sq_dist") + 1e-9)).cast("long").alias("n_misplaced"),
        F.sum("own_dist").alias("_inertia"))
    placed = told.withColumnRenamed("own", "cluster").join(pts, ["slice", "point_id"])
    stats = km.cluster_stats(placed, ["slice"]).join(cents.select("slice", "cents"), "slice")
    gap = km.sq_dist(F.col("centroid"), F.get("cents", F.col("cluster")))
    off = stats.groupBy("slice").agg(F.count_if(gap > 0.05).cast("long").alias("n_off_centre"))
    open_ = inertia.groupBy("slice").agg(F.count_if(~F.col("converged")).cast("long").alias("n_open"))
    once = _assign_step(spark, sf).groupBy("slice").agg(F.sum("sq_dist").alias("_once"))
    return per.join(off, "slice").join(open_, "slice").join(once, "slice").select(
        "slice", "n", "n_misplaced", "n_off_centre", "n_open", (F.col("_inertia") <= F.col("_once")).alias("no_worse"))


def cluster_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the converged clustering, held against what must hold: inertia and the
    Calinski-Harabasz index give the slice's total sum of squares back."""
    assigned, _, _ = _kmeans(spark, sf)
    pts = _points(spark, sf)
    m = km.quality_metrics(assigned.join(pts, ["slice", "point_id"]), ["slice"])
    total = F.col("inertia") * (F.lit(1.0) + F.col("calinski_harabasz") * (F.col("k") - 1) / (F.col("n") - F.col("k")))
    return m.select("slice", "n", "k", F.round(total, 4).alias("total_sum_of_squares"),
                    F.col("silhouette_sqeuclidean").between(-1.0, 1.0).alias("silhouette_in_range"),
                    (F.col("davies_bouldin") > 0).alias("davies_bouldin_positive"))


def kmeans_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector's cluster in the converged clustering (no SQL; ``kmeans_grouped`` has what must hold of it)."""
    assigned, _, _ = _kmeans(spark, sf)
    return assigned.select("slice", F.col("point_id").alias("vec_id"), "cluster", r6("sq_dist").alias("sq_dist"))


def cluster_metric_values(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the converged clustering (no SQL; ``cluster_metrics`` has what must hold of them)."""
    assigned, _, _ = _kmeans(spark, sf)
    m = km.quality_metrics(assigned.join(_points(spark, sf), ["slice", "point_id"]), ["slice"])
    return rounded(m, ["inertia", "silhouette_sqeuclidean", "calinski_harabasz", "davies_bouldin"])



def queries() -> dict[str, Query]:
    return {
        "effect_by_wording": effect_by_wording,
        "effect_sparse": effect_sparse,
        "theme_contingency": theme_contingency,
        "two_proportion": two_proportion,
        "bar_counts": bar_counts,
        "bar_segments": bar_segments,
        "bar_layout": bar_layout,
        "binomial_tail": binomial_tail,
        "forecast_verdict": forecast_verdict,
        "forecast_counts": forecast_counts,
        "forecast_tests": forecast_tests,
        "forecast_check": forecast_check,
        "list_normalise": list_normalise,
        "prompt_grid": prompt_grid,
        "grid_unknown_templates": grid_unknown_templates,
        "axis_plan": axis_plan,
        "ending_class": ending_class,
        "secret_hits": secret_hits,
        "secret_scan": secret_scan,
        "labelling_prompts": labelling_prompts,
        "justification_prompts": justification_prompts,
        "first_seen_rank": first_seen_rank,
        "summary_counts": summary_counts,
        "shape_checks": shape_checks,
        "label_coverage": label_coverage,
        "coef_panels": coef_panels,
        "axis_projection": axis_projection,
        "projection_sign": projection_sign,
        "axis_projection_means": axis_projection_means,
        "effect_on_projection": effect_on_projection,
        "slice_manifest": slice_manifest,
        "slice_read": slice_read,
        "stored_slice_pairs": stored_slice_pairs,
        "coefficients": coefficients,
        "bank_normalised": bank_normalised,
        "noted_checks": noted_checks,
        "justification_prompts_head": justification_prompts_head,
        "manifest_integrity": manifest_integrity,
        "pair_missing_texts": pair_missing_texts,
        "short_slices": short_slices,
        "null_key_index": null_key_index,
        "missing_reference": missing_reference,
        "kmeans_assign_step": kmeans_assign_step,
        "cluster_quality": cluster_quality,
        "kmeans_grouped": kmeans_grouped,
        "cluster_metrics": cluster_metrics,
        "kmeans_assignments": kmeans_assignments,
        "cluster_metric_values": cluster_metric_values,
    }
