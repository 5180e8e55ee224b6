"""The queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .chat import Template, formatted, joined, loss_text, parsed
from .common import Scratch, table
from .exact_dedup import exact_copies
from .line_dedup import drop_site_lines
from .minhash import near_copies
from .mixing import planned, word_count
from .packing import packed, token_pieces
from .quality import judged
from .suffix_dedup import repeated_spans
from .token_store import checksums, read_tokens, write_tokens
from .warc import read_warc, write_warc


def op1_line_dedup(spark, sf_dir):
    """Lines of each document, lines dropped as its source's boilerplate, and what is left."""
    out = drop_site_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def pack_documents(documents):
    """The pieces of all documents with their sequences, as op2 and the pipeline return them."""
    placed = packed(token_pieces(documents, "doc_id", "text"))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_warc_salvage(spark, sf_dir):
    """All pages written as archives and read back; gaps would show as rows without a page."""
    folder = Scratch(spark, "archives").path("warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    out = read_warc(spark, folder, with_payload=False)
    return out.select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op4_quality_rules(spark, sf_dir):
    out, verdict = judged(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), carry=["doc_id"])
    v = F.col(verdict)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")
    return out.select("doc_id", *[v[x].alias(x) for x in names])


def op5_source_mixing(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.coalesce("text", F.lit(""))).alias("size"))
    sizes = Scratch(spark, "sizes").keep(sizes, "sizes")
    out, plan = planned(sizes, "size")
    p = F.col(plan)
    return out.select("doc_id", "size", p["source_size"].alias("source_size"), p["target"].alias("target"), p["taken"].alias("taken"))


def op6_exact_dedup(spark, sf_dir):
    return exact_copies(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    out = repeated_spans(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


def op8_token_orc(spark, sf_dir):
    path = Scratch(spark, "tokens").path("orc")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return checksums(read_tokens(spark, path))


def op9_chat_format(spark, sf_dir):
    template = Template()
    own = "</s>[INST] ok [/INST]"
    more = spark.sql(
        "SELECT conv_id, turn, role, text FROM VALUES (-1L, 0L, 'user', '{0}'), (-1L, 1L, 'assistant', '{0}') AS t(conv_id, turn, role, text)".format(own)
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = Scratch(spark, "chat").keep(formatted(turns, template), "segments")
    text = out.withColumn("text", joined(F.col("segments"))).withColumn("loss", loss_text(F.col("segments")))
    text = text.withColumn("turns", parsed(F.col("text"), template))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return text.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
        "valid",
    )


def op10_minhash_dedup(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents"))


def queries():
    every = (
        op1_line_dedup, op2_best_fit_packing, op3_warc_salvage, op4_quality_rules, op5_source_mixing,
        op6_exact_dedup, op7_suffix_dedup, op8_token_orc, op9_chat_format, op10_minhash_dedup,
    )
    return {f.__name__: f for f in every}
