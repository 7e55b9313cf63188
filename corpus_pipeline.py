"""Corpus pipeline over the documents table.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` that works on all
its predecessor kept.  All but the last return the columns of documents:

1. toxicity: documents that the classifier rejects go.
2. near-duplicates: of each group of linked SimHash fingerprints the document
   of least doc_id stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. secrets: every span found is replaced by a placeholder inside the text;
   n_chars follows the new text; no document goes.
5. tokenisation: token ids of every text, with the digests of ids and decoded bytes.

Defined results: the operators' own rules hold for NULLs, empty and very long
texts, ties, repeated rows and further columns (the latter pass through stages 1
to 4); an empty table stays empty.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bpe, common, decontam, secrets, simhash, toxicity
from panelforge.llm.queries import VOCABULARY, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    packed, columns = common.pack(docs, "doc_id", "text")
    return toxicity.classify(packed, model).filter("predicted = 0").select(columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=4, distance=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed, columns = common.pack(docs, "doc_id", "text", "n_chars")
    hidden = secrets.redact_secrets(packed.withColumn("_was", F.xxhash64("text")))
    changed = ~F.xxhash64("text").eqNullSafe(F.col("_was"))
    return hidden.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    pattern = public_tokenizers.PATTERN
    ranks = bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY))
    return bpe.digest(bpe.encode(docs.select("doc_id", "text"), ranks, pattern, decoded="decoded"), keep=("ids",))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", hide_secrets),
    ("byte-level BPE", tokenise),
]

#: No SQL: classifier, XXH64 fingerprints, zstandard sizes and BPE merges are beyond DuckDB.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, name.replace(" ", "-"))
    return docs
