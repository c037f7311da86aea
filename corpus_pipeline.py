"""Five stages from raw documents to token files; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import public_tokenizers

from polyrun.llm.common import fresh_path, table
from polyrun.llm.decontaminate import without_contaminated
from polyrun.llm.mixing import mixed_documents
from polyrun.llm.simhash import without_near_duplicates
from polyrun.llm.tokens import read_token_ids, token_id_files, with_crc32
from polyrun.llm.toxicity import without_toxic


def toxicity(spark, docs, sf_dir):
    """Drops the documents that the model predicts toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """Of each group of documents linked by a similarity of 0.8 of their five-word shingles, the smallest doc_id stays."""
    return without_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Drops the documents that hold half of a benchmark item or more."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """The documents of the weighted mix, each as often as it is taken."""
    return mixed_documents(docs)


def token_files(spark, docs, sf_dir):
    """Writes the token ids and returns doc_id, start, n_tokens, ids_crc32 read back from the files."""
    return with_crc32(read_token_ids(spark, token_id_files(docs, public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_files)]

#: SQL cannot express hashing to SimHash fingerprints, the learned model or the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages on documents, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
