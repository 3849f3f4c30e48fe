"""One thin query per operator: whole driver tables in, the contract's digest columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .chat import chain, format_conversations, read_turns, unescape
from .decontam import find_overlaps
from .disclosure import sanitise
from .divergence import source_divergence
from .licenses import known_digests, scan_licenses
from .mixing import mix_sources
from .neardup import near_duplicates
from .neighbours import nearest
from .shards import shard_documents
from .substrings import remove_repeats
from .tokenfiles import read_tokens, write_tokens
from .toxicity import score_documents, train


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a chain of replies, so it has one path; texts are read back from it."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").union(extra)
    messages = chain(turns, "conv_id", ["turn", "role", "text"]).drop("turn")
    done = format_conversations(messages, "conv_id")
    back = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                       F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                                lambda s: unescape(s["text"])), "").alias("loss"))
    per_turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(per_turn, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return shard_documents(docs, shards=24).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"), shingle_words=3, percent=85)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents", "doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_read(spark, sf_dir, "documents", "doc_id", "text"), known_digests(spark))
    return found.select("doc_id", "text_digest", "text_license",
                        F.array_join("line_licenses", ",").alias("line_licenses"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(_read(spark, sf_dir, "documents", "doc_id", "text"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    files = write_tokens(_read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer, end_id=2, by_piece=True)
    return read_tokens(files).select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, _read(spark, sf_dir, "labels", "doc_id", "toxic"))
    # a null id is in no fitting fold
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(True))
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    found = find_overlaps(docs, _read(spark, sf_dir, "benchmark", "item_id", "text"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_read(spark, sf_dir, "documents", "lang", "source", "text"), min_docs=10, top=10)


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    if a_path is None or b_path is None:
        import public_tokenizers
        a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
        b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    return align_tokenizers(_read(spark, sf_dir, "documents", "doc_id", "text"), a_path, b_path)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sanitise(_read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "term")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return done.select(
        "doc_id", *[F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
                    for k in ("email", "ip", "card", "phone")],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_chat_formatting, op2_rendezvous_shards, op3_near_duplicates, op4_source_mix, op5_license_scan,
        op6_nearest_neighbours, op7_substring_dedup, op8_token_files, op9_toxicity, op10_decontamination,
        op11_source_divergence, op12_cross_tokenizer, op13_personal_data)}
