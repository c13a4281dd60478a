"""From raw documents to packed training sequences: five stages, each an operator of stemma.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm._tables import stored
from stemma.llm.decontaminate import clean
from stemma.llm.langid import known_languages, train
from stemma.llm.packing import pack_documents, sequences
from stemma.llm.simhash import deduplicate
from stemma.llm.substring import remove_repeats

#: The score that a document's language needs, the shingles and similarity of near-copies, and the tokens of a sequence.
LEAST_SCORE, SHINGLE_WORDS, SIMILARITY, CAPACITY = 0.5, 5, 0.8, 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the byte network has learned and finds likelier than the others and noise together; texts that are null or have no letter go."""
    return known_languages(docs, train(docs), least=LEAST_SCORE)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-copies: five-word shingles of a Jaccard similarity of 0.8 or more."""
    return deduplicate(docs, words=SHINGLE_WORDS, similarity=SIMILARITY)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what 20-word windows of earlier documents hold already; documents of which nothing is left go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = remove_repeats(docs, width=20, layout="text", keep=others)
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else F.lit(None)}
    return left.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens; see training_sequences() for the ids."""
    return pack_documents(docs, capacity=CAPACITY, end_id=0).drop("room")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [(f.__name__, f) for f in (language_id, simhash_near_dedup, substring_dedup, benchmark_decontamination, best_fit_packing)]

#: Language ID, near-copies by similarity and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the last stage packs: all stages but it, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: a row for each piece, with its place in a sequence."""
    return STAGES[-1][1](spark, prepared(spark, sf_dir), sf_dir)


def training_sequences(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """What a trainer reads, written to `path` as Parquet: sequence_id and ids (array of int, at most CAPACITY) of every packed sequence."""
    docs = prepared(spark, sf_dir)
    pieces = stored(best_fit_packing(spark, docs, sf_dir), "pieces")
    sequences(docs, pieces, end_id=0).write.parquet(path)
    return spark.read.parquet(path)
