"""A training-corpus pipeline: each stage reads what the one before it wrote.

Language identification and toxicity drop the documents that they reject, near-duplicate detection keeps one document of
each group, the secret scan redacts, and packing cuts and packs the rest.

All stages take any table that has the columns of documents, an empty one too (it gives an empty table). All but the last
return these columns only: others, also such as are named like something a stage computes (score, rep, spans), are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperloom.llm import language, minhash, packing, secrets, toxicity
from paperloom.llm.common import checkpoint_dir, crc_mod, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark, docs, sf_dir):
    """Drops documents without text or letters, and those too far from every learned language.

    Learns from the documents at hand. So null and empty texts go; very long ones are read whole. Of languages that tie the first in the
    alphabet counts, which changes no decision. Rows that repeat share their fate, and a null doc_id or lang changes nothing.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.train(docs.filter(~held))
    return language.identify(docs, model, keep=COLUMNS[1:]).filter("not rejected").select(*COLUMNS)


def toxicity_filter(spark, docs, sf_dir):
    """Drops documents that score 0.5 or more.

    Null and empty texts have no feature: their score is the bias alone, below 0.5, so they stay. Very long texts are read whole, and equal
    texts share their fate. A document whose id is null is scored, but nothing is learned from it.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    learn = ~toxicity.holdout(F.col("doc_id"))
    model = toxicity.train(docs.select("doc_id", "text").filter(learn), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(learn))
    return toxicity.score(docs, model, keep=COLUMNS[1:]).filter("tox_score < 0.5").select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """Keeps of each group the document with the smallest doc_id, and of rows that share a doc_id the one with the smallest text (nulls first), lang, source and n_chars.

    Null, empty and blank texts and null ids are alone in their groups and stay. Very long texts are compared whole.
    """
    docs = docs.select(*COLUMNS)
    near = minhash.near_duplicates(docs)
    out = docs.join(near.filter("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    one = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return out.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def secret_scan(spark, docs, sf_dir):
    """Redacts secrets that aren't widely copied examples; every row stays.

    Null and empty texts stay as they are, long ones are scanned whole, equal texts change alike.
    """
    return secrets.redact(docs.select(*COLUMNS))


def pack(spark, docs, sf_dir):
    """Packs the documents into sequences; a row for each piece.

    Null and empty texts are one piece of one token. Long texts are cut into pieces of 2048 tokens. Every row, also a repeated one or one
    without a doc_id, is a document of its own; of bins or pieces that tie the earlier one counts.
    """
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("pack", pack)]

#: Learned models, connected components and BPE are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{base}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
