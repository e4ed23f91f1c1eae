"""Registered queries of this folder: each operator over its whole table, with production parameters."""

from public_tokenizers import path as tokenizer_path

from vectormart.llm import (bpe, conversations, exact_dedup, fingerprints, language, mixing, near_dedup, periodic, pii,
                            sharding, span_dedup, suffix_dedup, token_files)
from vectormart.session import work_folder

BYTE_BPE = tokenizer_path("byte_bpe_50k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")
END_ID = 2


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def op1_span_dedup(spark, sf_dir):
    return span_dedup.repeats(documents(spark, sf_dir))


def op2_sharding(spark, sf_dir):
    return sharding.placements(documents(spark, sf_dir))


def op3_pii(spark, sf_dir):
    return pii.personal_data(documents(spark, sf_dir))


def op4_bpe(spark, sf_dir):
    return bpe.digests(documents(spark, sf_dir), BYTE_BPE)


def op5_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints_beside_edits(documents(spark, sf_dir))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op7_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op8_token_files(spark, sf_dir):
    path = work_folder(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), path, BYTE_BPE, END_ID)
    return token_files.token_file_digests(spark, path)


def op9_mixing(spark, sf_dir):
    return mixing.mixed(documents(spark, sf_dir))


def op10_language(spark, sf_dir):
    return language.predictions(documents(spark, sf_dir), PIECES)


def op11_periodic_runs(spark, sf_dir):
    return periodic.run_digests(documents(spark, sf_dir))


def op12_conversation_repair(spark, sf_dir):
    return conversations.repair_digests(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))


def op13_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_digests(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_span_dedup, op2_sharding, op3_pii, op4_bpe, op5_fingerprints, op6_exact_dedup, op7_near_dedup, op8_token_files,
    op9_mixing, op10_language, op11_periodic_runs, op12_conversation_repair, op13_suffix_dedup)}
SQL = {"op2_sharding": sharding.placement_sql(), "op6_exact_dedup": exact_dedup.GROUPS_SQL}
