"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from tallyfold.llm.common import table
from tallyfold.llm.oracles import ORACLES  # noqa: F401 (the entry module reads it)


def op1_passages(spark, sf_dir):
    from tallyfold.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_hnsw(spark, sf_dir):
    from tallyfold.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark, sf_dir):
    from tallyfold.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark, sf_dir):
    from tallyfold.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5_bpe(spark, sf_dir):
    from tallyfold.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), bpe_path())


def op6_suffix(spark, sf_dir):
    from tallyfold.llm.suffix import dedupe_substrings

    return dedupe_substrings(table(spark, sf_dir, "documents")).drop("spans")


def op7_mixing(spark, sf_dir):
    from tallyfold.llm.mixing import mixed_counts

    return mixed_counts(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    from tallyfold.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op9_fingerprint(spark, sf_dir):
    from tallyfold.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op10_secrets(spark, sf_dir):
    from tallyfold.llm.secrets import report

    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op1_passages": op1_passages, "op2_hnsw": op2_hnsw, "op3_toxicity": op3_toxicity, "op4_simhash": op4_simhash, "op5_bpe": op5_bpe, "op6_suffix": op6_suffix, "op7_mixing": op7_mixing, "op8_token_counts": op8_token_counts, "op9_fingerprint": op9_fingerprint, "op10_secrets": op10_secrets}
