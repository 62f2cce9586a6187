"""The queries of this subpackage: op1 to op13 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowguard.llm import (
    bpe,
    chat,
    decontaminate,
    filter_audit,
    line_dedup,
    mixture,
    quality,
    ranked_search,
    secrets,
    shards,
    simhash_dedup,
    sql,
    substring_dedup,
    suffix_dedup,
)
from windowguard.llm.registry import query

SHARDS = 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(sql.OP3)
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(sql.OP4)
def op4_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 contiguous shards of nearly equal size."""
    placed = shards.shard_documents(table(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdicts of all documents, by a labeller fitted on the labelled ones."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"))
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept content_words"
    return quality.judge(docs, model).select(columns.split())


@query()
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and class of all documents."""
    classes = simhash_dedup.fingerprint_classes(table(spark, folder, "documents"))
    return classes.select("doc_id", simhash_dedup.hex64("fp").alias("fingerprint"), "component_id")


@query(sql.OP1)
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the 20-word passages that occurred before."""
    kept = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def tokenizer() -> chat.Vocabulary:
    """The vocabulary of the production run; the path of another one can be given instead."""
    import public_tokenizers

    return chat.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query(sql.chat_sql(chat.TAILS, len(chat.START + chat.MESSAGE + chat.END)))
def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted and read back."""
    vocabulary = tokenizer()
    turns = chat.with_probe(spark, table(spark, folder, "conversations"))
    return chat.read_back(chat.format_turns(turns, vocabulary), vocabulary)


@query(sql.secrets_sql([(r.name, r.pattern, r.group, r.least) for r in secrets.RULES], len(secrets.BASE_RULES)))
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents, over a ledger that starts empty."""
    return secrets.report(table(spark, folder, "documents"), secrets.new_ledger(spark))


#: The production mixture; the SQL of the query states the same weights.
RECIPE = mixture.Recipe(weights={"domain0": 4, "domain1": 2}, share=50, max_epochs=2, seed=42)


@query(sql.OP9)
def op9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a weighted mixture and how often each is used."""
    chosen = mixture.select(table(spark, folder, "documents"), RECIPE)
    return chosen.select("row.doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", "epochs")


@query()
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all documents that repeat, or nearly repeat, an earlier line."""
    return line_dedup.report(table(spark, folder, "documents"))


@query()
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the 400-byte strings that start twice."""
    kept = suffix_dedup.remove_repeated_bytes(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def merges() -> bpe.Merges:
    """The merges of the production run; the path of another tokenizer file can be given instead."""
    import public_tokenizers

    return bpe.Merges.read(public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return bpe.round_trip(table(spark, folder, "documents"), merges())


HITS = 10


@query(sql.search_sql(HITS))
def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for each benchmark item, over an index of all documents."""
    index = ranked_search.build_index(table(spark, folder, "documents"))
    return ranked_search.search(index, table(spark, folder, "benchmark"), HITS)


@query(sql.audit_sql(filter_audit.steps(), filter_audit.MIN_WORDS, filter_audit.DISTINCT_PERCENT, filter_audit.CAPITAL_PERCENT))
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from all documents, in every order."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
