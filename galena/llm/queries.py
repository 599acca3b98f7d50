"""One thin query per operator: the whole table in, the contract's columns out."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, decontam, htmltext, langid, neardup, oracles, pii, quality, suffixdedup, tokenpack, warc
from .common import Scratch, checkpoint, table
from .registry import query


@query("op1_warc", oracles.WARC)
def op1(spark, sf_dir):
    with Scratch(spark) as scratch:
        warc.write_archive(table(spark, sf_dir, "pages"), at := scratch.path())
        found = warc.parse(warc.read_archive(spark, at))
        return checkpoint(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@query("op2_token_files")
def op2(spark, sf_dir):
    with Scratch(spark) as scratch:
        tokenpack.write(table(spark, sf_dir, "documents"), at := scratch.path())
        return tokenpack.index(spark, at)


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    return suffixdedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


@query("op4_bpe")
def op4(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op5_near_duplicates", oracles.NEAR_DUPLICATES)
def op5(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@query("op6_quality_rules", oracles.QUALITY)
def op6(spark, sf_dir):
    return quality.measure(table(spark, sf_dir, "documents")).drop("cleaned")


@query("op7_decontamination", oracles.DECONTAMINATION)
def op7(spark, sf_dir):
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op8_html_text")
def op8(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep_html=False)


@query("op9_surrogates")
def op9(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


@query("op10_language")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prototypes = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
