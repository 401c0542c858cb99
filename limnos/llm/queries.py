"""The registered queries of the operators: thin digests over each operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_scan, decontamination, filter_audit, html_text, language_id, lz_fingerprint, mixing, near_dedup, pii_crf, prefix_trie, token_orc, url_filter
from .common import scratch_path, table
from .oracles import OP2, OP3, OP6, OP11, OP13
from .sharding import shard_documents

#: The byte-level BPE vocabulary of the public tokenizers; never copied into the repository.
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks.
RANKS = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), n_shards=16)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Host, path and verdict of each rule.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op3_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii.*")


def op5_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edit_probe(table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.n_hit()
    return out.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "tokens", "weight", "epoch", "block", "block_order", "doc_order")


def op8_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out()))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-orc")
    token_orc.write_token_orc(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_orc.document_index(spark, path)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_bpe_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_path(RANKS)
    out = bpe_scan.decode(bpe_scan.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    n_tokens = F.floor(F.coalesce(F.octet_length("ids"), F.lit(0)) / 4).cast("long")
    return out.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_redirect_equivalence": op2_redirect_equivalence,
    "op3_minhash_bayes": op3_minhash_bayes,
    "op4_pii_crf": op4_pii_crf,
    "op5_lz_fingerprints": op5_lz_fingerprints,
    "op6_winnowing": op6_winnowing,
    "op7_temperature_mixing": op7_temperature_mixing,
    "op8_consensus_html": op8_consensus_html,
    "op9_language_cnn": op9_language_cnn,
    "op10_token_orc": op10_token_orc,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_bpe_scan": op12_bpe_scan,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {"op2_redirect_equivalence": OP2, "op3_minhash_bayes": OP3, "op6_winnowing": OP6, "op11_prefix_trie": OP11, "op13_filter_audit": OP13}
