"""The registered query of each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsheaf.llm import (
    chat,
    conversation_oracle,
    conversation_repair,
    language,
    oracle,
    secret_scan,
    toxicity,
    url_filter,
)
from logsheaf.llm.collision_search import nearest
from logsheaf.llm.decontamination import contaminated
from logsheaf.llm.jaccard_join import near_duplicates
from logsheaf.llm.language import held_out
from logsheaf.llm.lz_fingerprints import compare_with_edits
from logsheaf.llm.packing import pack
from logsheaf.llm.prefix_trie import prefix_trie
from logsheaf.llm.token_counts import count_tokens

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def _listed(spans: Column) -> Column:
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(one, ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.new_ledger(spark))
    base = [rule.kind for rule in secret_scan.BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = turns.unionByName(added).withColumn("parts", chat.text_parts(F.col("text")))
    back = F.transform(
        chat.read_back(F.col("formatted")),
        lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")),
    )
    learned = F.array_join(chat.under_loss(F.col("formatted"), F.col("loss_spans")), "")
    return (
        chat.format_chat(rows)
        .withColumn("learned", learned)
        .select(
            "conv_id",
            F.size(chat.read_back(F.col("formatted"))).cast("long").alias("n_turns"),
            F.sha2(F.array_join(back, ""), 256).alias("turns_sha256"),
            F.length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


# The rules of the filter, each a host and the start of a path.
URL_RULES = {
    "net/": "block",
    "example.net/en/": "allow",
    "example.com/de/": "block",
    "org/fr/": "allow",
}


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("blocked")
    )
    model = url_filter.train(pages.join(labels, "page_id"))
    return url_filter.judge(pages, URL_RULES, model)


def op7_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out()))
    return language.identify(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "lang_pred",
        "score",
        F.size("spans").alias("n_spans"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    model = toxicity.train(toxicity.labelled_texts(docs, labels))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        "predicted",
        F.size("offending").alias("n_offending"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations with the faults that a hash of conversation and turn picks.

    A dropped row stays as one that is ``lost``, so that its conversation is known.
    """
    space = F.lit(" ")
    name = F.concat_ws(
        ":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    )
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("fate"),
    )
    text = F.when(F.col("fate") == 1, "").when(
        F.col("fate") == 2, F.translate("text", ".!?", "")
    )
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.coalesce(text, F.col("text")).alias("text"),
        (F.col("fate") == 0).alias("lost"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(_table(spark, sf_dir, "conversations"))
    return conversation_repair.summaries(conversation_repair.repair(turns, lost="lost"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scan": op3_secret_scan,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_url_filter": op6_url_filter,
    "op7_lz_fingerprints": op7_lz_fingerprints,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op1_decontamination": oracle.DECONTAMINATION,
    "op3_secret_scan": oracle.SECRETS,
    "op4_chat_formatting": oracle.CHAT,
    "op5_ngram_jaccard_join": oracle.NEAR_DUPLICATES,
    "op11_conversation_repair": conversation_oracle.REPAIR,
    "op13_prefix_trie": conversation_oracle.TRIE,
}
