"""The queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import digests as chat_digests
from .chat_format import format_chats
from .common import table
from .decontamination import decontaminate
from .divergence import audit
from .html_text import extract
from .jaccard_join import jaccard_join
from .license_digests import PLANTED, known_licenses, scan_licenses
from .lm_scores import score
from .oracles import all_sql
from .packing import pack
from .quality_rules import quality_rules
from .revisits import header_lines, resolve_revisits
from .spelling import variants
from .substring_dedup import dedup
from .token_counts import count_tokens


def tokenizer_file(name: str) -> Path:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return Path(public_tokenizers.path(name))


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records of pages: each page's full response, a revisit just before it and one 1000 captures later.
    Of three pages one has an entity tag, one a last-modified time and one its payload digest alone as validator."""
    html = F.coalesce("html", F.lit(""))
    one = pages.select(F.col("page_id").cast("long").alias("k"), "url", F.md5(html.cast("binary")).alias("tag"), F.sha2(html.cast("binary"), 256).alias("sha"), F.octet_length(html).cast("string").alias("size"))
    k, part = F.col("k"), F.pmod(F.col("k"), F.lit(3))
    none = F.lit(None).cast("string")

    def headers(date, tag, **others):
        pairs = {name.replace("_", "-"): c for name, c in others.items()} | {"date": date.cast("string"), "etag": F.when(part == 0, tag), "last-modified": F.when(part == 1, F.concat(F.lit("as of "), F.col("tag")))}
        return F.map_filter(F.create_map(*(x for n, c in pairs.items() for x in (F.lit(n), c))), lambda _, v: v.isNotNull())

    full = headers(k, F.concat(F.lit("W/"), F.col("tag")), content_type=F.lit("text/html"), content_length=F.col("size"))
    short = lambda date: headers(date, F.col("tag"), content_length=F.lit("0"), server=F.lit("edge"))
    record = lambda n, ts, kind, has, digest: F.struct((3 * k + n).alias("record_id"), ts.alias("ts"), F.lit(kind).alias("kind"), has.alias("headers"), digest.alias("payload_digest"))
    own = F.when(part == 2, F.col("sha")).otherwise(none)
    rows = F.array(record(0, 2 * k, "revisit", short(2 * k), own), record(1, 2 * k + 1, "response", full, F.col("sha")), record(2, 2 * k + 2001, "revisit", short(2 * k + 2001), own))
    return one.select("url", F.explode(rows).alias("r")).select("r.record_id", "url", "r.ts", "r.kind", "r.headers", "r.payload_digest")


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    return done.select("record_id", "page", "ts", "outcome", "refers_to", header_lines(F.col("headers")).alias("header_lines"), "payload_digest")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, and as rows that match (doc_id -1, -2, ...) the known texts in capitals below a copyright line."""
    known = known_licenses(spark)
    planted = [(-1 - k, PLANTED + r["text"].upper()) for k, r in enumerate(known.collect())]  # the library's own texts
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    return scan_licenses(docs, known)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_digests(format_chats(rows))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json").read_text())


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model").read_bytes())


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_revisits, op2_decontaminate, op3_licenses, op4_chat_format, op5_pack, op6_main_text, op7_token_counts, op8_jaccard_join, op9_quality_rules, op10_lm_scores, op11_divergence, op12_spelling, op13_substring_dedup)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return all_sql()
