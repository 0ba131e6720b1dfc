"""The subpackage's registered queries: thin digests over the operators, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftworks.llm.conversation_trie import numbered_turns, prefix_trie, with_heads
from siftworks.llm.decontamination import find_leaks
from siftworks.llm.fill_in_middle import fill_in_middle, restored
from siftworks.llm.gif import media_digests, text_to_gif
from siftworks.llm.html_extraction import default_model, extract_text
from siftworks.llm.licenses import scan_licenses
from siftworks.llm.mixing import mix, n_words
from siftworks.llm.pii import as_string, find_pii
from siftworks.llm.quality import score_quality
from siftworks.llm.scratch import Scratch, small_batches
from siftworks.llm.simhash import simhash_components
from siftworks.llm.substring_dedup import remove_repeated_windows
from siftworks.llm.suffix_dedup import remove_earlier_strings
from siftworks.llm import oracles, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: base spans by kind, and all spans with those that weak supervision adds."""
    scratch = Scratch(spark)
    found = find_pii(_read(spark, sf_dir, "documents"), scratch, keep=["doc_id"])
    base = F.col("pii_base")
    counts = [F.size(F.filter(base["kind"], lambda kind: kind == k)).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    scratch.hold()
    return found.select("doc_id", *counts, F.sha2(as_string(base).cast("binary"), 256).alias("base_sha256"), as_string(F.col("pii_spans")).alias("spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents` against whole `benchmark`: each leaking document and item with its best window."""
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: words left after removing every repeated window of 35 words."""
    found = remove_repeated_windows(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: bytes left after removing 50-byte strings that smaller doc_ids hold."""
    found = remove_earlier_strings(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: fingerprint and the least doc_id reachable over links of two bits or fewer."""
    found = simhash_components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: each text stored as a GIF and read back."""
    return media_digests(text_to_gif(_read(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: words each document puts into the mix."""
    docs = _read(spark, sf_dir, "documents")
    found = mix(docs.select(F.col("doc_id").alias("id"), "source", n_words(F.col("text")).alias("size")))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "rate")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null doc_id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: probability that a text is toxic, from its nearest labelled examples."""
    docs = _read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, toxic_labels(spark, sf_dir)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: license templates each document holds."""
    found = scan_licenses(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "first_word", "n_words", "containment")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `pages`: main text of every page."""
    found = extract_text(_read(spark, sf_dir, "pages"), default_model())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `conversations`, each with its family's opening: one row per node of their prefix trie."""
    with Scratch(spark) as scratch:
        turns, convs = with_heads(numbered_turns(_read(spark, sf_dir, "conversations"), scratch))
        return prefix_trie(turns, convs, scratch)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: digests of the transformed text and of the text restored from it."""
    made = fill_in_middle(_read(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def quality_held_out(doc_id: Column) -> Column:
    """Rows whose quality labels are never learnt from; a null doc_id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: probability that a text is of good quality."""
    labels = _read(spark, sf_dir, "labels").where(~quality_held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    with Scratch(spark) as scratch:
        found = score_quality(_read(spark, sf_dir, "documents"), labels, scratch)
    return found.select("doc_id", quality_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_gif": op6_gif,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_html_extraction": op10_html_extraction,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_quality": op13_quality,
}
#: The others cannot be written in SQL, or not at the length of whole texts; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op3_substring_dedup": oracles.OP3, "op9_license_scan": oracles.license_sql(), "op11_conversation_trie": oracles.OP11, "op12_fill_in_middle": oracles.OP12}
