"""A corpus from raw documents: five stages, each an operator of pointwright.llm on all rows that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Where a text changes, n_chars is its new number of code points. Rows with
a null id pass the first stage and take no part in the later ones. An empty table stays empty.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointwright.llm import jaccard_join, mixing, sentencepiece_codec, substring_dedup, toxicity
from pointwright.llm.queries import documents, labels, vocabulary
from pointwright.llm.work import small_batches, written


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, by the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    scored = toxicity.classify(docs, labels(spark, sf_dir), folds=5, held_out=0, keep=rest)
    return scored.where("predicted = 0").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of the similarity join connect, the one with the smallest id stays."""
    first = jaccard_join.link(docs, words=5, percent=75).where("component_id = doc_id").select("doc_id")
    return docs.join(first, "doc_id", "left_semi").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 13 that a document with a smaller id has are cut; other texts stay as they are."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = substring_dedup.remove_repeated(docs, length=13, carry=rest, untouched="original")
    return _sized(cut.withColumnRenamed("kept_text", "text").select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each text becomes the words of it that the mix takes, repeats repeated; documents without any leave."""
    return _sized(mixing.mixed_texts(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of the texts, with the digests of the text that they decode to and of the pieces' byte spans."""
    return sentencepiece_codec.encode(docs, vocabulary("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids", "decoded_sha256", "spans_sha256"))


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: MB of an Arrow batch: an executor keeps buffers of that kind from stage to stage, beside a heap that has grown by then.
BATCH_MB = 4


def _stage(f):
    """A stage in which columns beside those of documents go by names of their own, so they can clash with none of an operator's."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark, BATCH_MB)
        extra = {c: f"__extra{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        out = f(spark, docs.withColumnsRenamed(extra), sf_dir)
        return out.withColumnsRenamed({new: c for c, new in extra.items()})

    return run_stage


STAGES = [
    ("toxicity", _stage(without_toxic)),
    ("n-gram Jaccard join", _stage(one_of_each)),
    ("substring dedup", _stage(without_repeats)),
    ("mixing sources to target weights", _stage(mixed)),
    ("SentencePiece encoding and decoding", _stage(encoded)),
]

#: Trained models and a subword encoder are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i + 1}")
    return docs
