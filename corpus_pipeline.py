"""The corpus pipeline: five stages over the documents table, each written and read again.

Every stage but the last returns rows of documents with the columns they had.
"""

from vectormart.llm import bpe, exact_dedup, language, mixing, near_dedup
from vectormart.llm.queries import BYTE_BPE, PIECES, documents
from vectormart.session import written

MIX_SHARE = 0.5

STAGES = [
    ("language", lambda spark, docs, sf_dir: language.recognised(docs, PIECES)),
    ("exact_dedup", lambda spark, docs, sf_dir: exact_dedup.exact_dedup(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: near_dedup.near_dedup(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mix(docs, MIX_SHARE)),
    ("bpe", lambda spark, docs, sf_dir: bpe.encoded_and_decoded(docs, BYTE_BPE)),
]

# Language models and minhash links are no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """(doc_id, n_tokens, ids, decoded_sha256) of the documents that pass all stages."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
