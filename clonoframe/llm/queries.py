"""The operators applied to the given tables: one query each, results as the driver reads them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoframe.llm import (
    chat_windows,
    language_bayes,
    license_scan,
    mixing,
    near_dedup,
    quality_gam,
    quality_rules,
    quartile_digest,
    source_divergence,
    structure_repair,
    substring_graph,
    token_huffman,
    unigram_tokens,
)
from clonoframe.llm.hashing import chunks
from clonoframe.llm.shared import freed_id, held_id, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def fold(column: str, parts: int, which: int) -> Column:
    """Whether crc32 of the id, written as text, leaves ``which``; a null id never does."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == which, F.lit(False))


#: A conversation made of control strings, added to those of the table.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    probe = spark.range(2).select(
        F.lit(-7).cast("long"), "id", F.expr("if(id = 0, 'user', 'assistant')"), F.lit(PROBE)
    )
    made = chat_windows.windows(turns.unionAll(probe))
    turn = chat_windows.parsed(F.col("formatted"), F.col("n_context"))
    read = made.select(
        "conv_id", "window", turn.alias("turns"),
        chat_windows.learnt(F.col("formatted"), F.col("spans")).alias("loss"),
        F.length("formatted").alias("chars"),
    ).select(
        "conv_id", "window", "loss", "chars", F.size("turns").alias("n"),
        F.array_join(
            F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
        ).alias("said"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"),
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    loss = F.array_join("w.loss", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars", "n_windows",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = (
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        "near_next",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(doc_id: int, text: str, own: str, following: str, beside: str) -> tuple:
            changed = quartile_digest.edited(text, following)
            print_ = quartile_digest.digest(changed)
            sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            near = quartile_digest.likeness
            return doc_id, len(text), sha, own, print_, near(own, print_), near(own, beside)

        rows = (row(*r) for r in quartile_digest.with_next(batches))
        for part in quartile_digest.pieces(rows, 1000):
            yield pd.DataFrame(part, columns=list(columns))

    return quartile_digest.neighbours(docs).mapInPandas(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double",
    ).withColumn("doc_id", freed_id())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 5, 0)
    model = language_bayes.train(docs.where(~held_out))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language_bayes.identified(rows, model).drop("text")


def labels_to_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels a quality model may see."""
    return table(spark, sf_dir, "labels").where(~fold("doc_id", 4, 2))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.train(docs, labels_to_learn(spark, sf_dir))
    scored = docs.select(
        "doc_id", fold("doc_id", 4, 2).alias("held_out"), quality_gam.scorer(model)("text").alias("score")
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= quality_gam.KEEP, 1).otherwise(0))


def op6_token_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_folder(spark)
    token_huffman.write_files(docs, path, token_huffman.tokenizer_file(), end_id=2)
    return token_huffman.read_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixture(docs).drop("source")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_rules.ledger(docs)
    base = quality_rules.passes(quality_rules.BASE)
    verdict = quality_rules.passes(quality_rules.POLICIES[quality_rules.DEFAULT_POLICY])
    return rows.select(
        "doc_id", *quality_rules.MEASURES, "failed_bits",
        (~base).alias("base_failed"), (base & verdict).alias("kept"),
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(held_id().alias("doc_id"), "text")
    vocab = unigram_tokens.vocabulary(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            doc_ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
            for a, b in chunks(texts):
                ids = unigram_tokens.encode(texts[a:b], vocab.value)
                back = unigram_tokens.decode(ids, vocab.value)
                yield pd.DataFrame(
                    {
                        "doc_id": doc_ids[a:b],
                        "n_pieces": [len(i) for i in ids],
                        "n_byte_pieces": [int(np.isin(i, vocab.value.bytes_id).sum()) for i in ids],
                        "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids],
                        "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back],
                        "same": [t == (o or "") for t, o in zip(back, texts[a:b], strict=True)],
                    }
                )

    return docs.mapInPandas(
        run,
        "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string,"
        " same boolean",
    ).withColumn("doc_id", freed_id())


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    cases, repaired = structure_repair.repair(structure_repair.damaged(turns))
    ids = turns.select(held_id("conv_id").alias("conv_id")).distinct()
    rows = ids.join(cases, "conv_id", "left").join(structure_repair.digests(repaired), "conv_id", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256().hexdigest()
    return rows.select(
        freed_id("conv_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = substring_graph.deduplicated(docs)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES: dict[str, Query] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_license_scan": op2_license_scan,
    "op3_fingerprints": op3_fingerprints,
    "op4_language_id": op4_language_id,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_huffman": op6_token_huffman,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_unigram_pieces": op10_unigram_pieces,
    "op11_structure_repair": op11_structure_repair,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_source_divergence": op13_source_divergence,
}
