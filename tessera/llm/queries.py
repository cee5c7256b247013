"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from tessera.llm import chat, codes, collocation, exact, lines, mixing, packing, sharding, simhash, substring, token_files, topk, toxicity
from tessera.llm.common import fresh_path, table


def tokenizer_path(name):
    """A public tokenizer file; the files are installed beside Python and not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark, sf_dir):
    return lines.drop_boilerplate(table(spark, sf_dir, "pages"))


def op2_chat(spark, sf_dir):
    return chat.read_back(chat.windows(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op3_substring(spark, sf_dir):
    return substring.digest(substring.drop_repeats(table(spark, sf_dir, "documents")))


def op4_token_files(spark, sf_dir):
    path = fresh_path(spark, "op4-token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), "words")
    return token_files.read_token_files(spark, path)


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op7_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op8_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), "bytes")


def op11_vector_codes(spark, sf_dir):
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"))


def op13_collocations(spark, sf_dir):
    return collocation.phrases(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_chat, op3_substring, op4_token_files, op5_mixing, op6_toxicity, op7_exact_dedup, op8_top_k, op9_simhash, op10_packing, op11_vector_codes, op12_sharding, op13_collocations)}
ORACLE_SQL = {"op1_line_dedup": lines.ORACLE, "op2_chat": chat.ORACLE, "op5_mixing": mixing.ORACLE, "op7_exact_dedup": exact.ORACLE, "op8_top_k": topk.ORACLE, "op11_vector_codes": codes.ORACLE, "op12_sharding": sharding.ORACLE, "op13_collocations": collocation.ORACLE}
