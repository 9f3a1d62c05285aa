"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import quality_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.quality_rules import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.quality_classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.token_files import token_files_round_trip

    return token_files_round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.piece_nbest import n_best_segmentations, segmentation_digest

    return segmentation_digest(n_best_segmentations(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.line_dedup import line_digest, with_removed

    return line_digest(with_removed(table(spark, sf_dir, "documents")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.secret_scan import secret_digest, secret_spans

    return secret_digest(secret_spans(table(spark, sf_dir, "documents")))


def op8_lattice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.lattice_near_duplicates import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.substring_dedup import removal_digest, remove_repeats

    return removal_digest(remove_repeats(table(spark, sf_dir, "documents")))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.partenum_join import near_duplicate_components

    return near_duplicate_components(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.tokenizer_alignment import alignment_digest

    return alignment_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.embedding_whitening import whitened_embeddings

    return whitened_embeddings(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.byte_bpe import round_trip_digest

    return round_trip_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op5_piece_nbest": op5_piece_nbest,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_lattice_near_duplicates": op8_lattice_near_duplicates,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_byte_bpe": op13_byte_bpe,
}

SQL: dict[str, str] = {"op1_quality_rules": quality_rules.sql()}
