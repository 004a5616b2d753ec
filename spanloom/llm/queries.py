"""The corpus queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.llm import alignment, decontam, embeddings, filters, jaccard, langid, lines, mixing, quality, sharding, suffixes, tokenfiles, warc
from spanloom.llm.shared import table


def vocabulary(name):
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_token_files(spark, sf_dir):
    files = tokenfiles.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), tokenfiles.ids_folder(spark))
    return tokenfiles.read(files)


def op3_embedding_dedup(spark, sf_dir):
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", quality.held_out("doc_id", 3, 1))
    path = vocabulary("piece_bpe_32k.model")
    langs, prob = langid.fit(docs.filter(~F.col("held_out")), path)
    return langid.predict(docs, langs, prob, path, keep=["doc_id", "held_out"])


def op5_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "pages"))


def op6_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", quality.held_out("doc_id", 4, 2))
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out("doc_id", 4, 2))
    scored = quality.score(docs, quality.fit(docs, labels), keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_mixing(spark, sf_dir):
    mixed = mixing.taken(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark, sf_dir):
    return warc.read_back(warc.archive(table(spark, sf_dir, "pages"), warc.archive_folder(spark)))


def op10_ngram_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark, sf_dir):
    left = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_token_alignment(spark, sf_dir):
    return alignment.links(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_filter_audit(spark, sf_dir):
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql():
    return {"op5_line_dedup": lines.ORACLE, "op9_warc": warc.ORACLE, "op13_filter_audit": filters.ORACLE}
