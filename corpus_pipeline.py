"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import langid, minhash, mixing, packing, secrets
from tidewright.llm.common import checkpoint_folder, fresh, read_table

#: Below this score a document's language is not told. Where the learned languages fall into two families, as the tables'
#: do, no score is below 0.5, so that only documents of unknown language go; see identify_language.
LEAST_SCORE = 0.2
#: Pieces that a worker's tokenizer remembers in each of two generations: fewer than in packing alone, as executors still hold
#: what the stages before took. Ids are the same.
REMEMBERED = 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the null texts and letterless ones, whose language is unknown.

    Texts in languages that the model didn't learn, and letter junk, stay unless their score falls below LEAST_SCORE,
    which it can't with two families of languages. Rows, repeats and further columns stay as they are.
    """
    language, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    told = langid.identify(docs, langid.fit(docs), keep=docs.columns, names=(language, score))
    return told.where((F.col(language) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least id; wordless texts and rows without an id stay (see minhash.deduplicated)."""
    return minhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts; null texts, repeats and further columns stay as they are."""
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (0 to 3 times); null sources are a source, null texts have size 0, further columns stay."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens; a null text is its end token, repeats are packed like any row."""
    return packing.pack(docs, remembered=REMEMBERED)


STAGES = [
    ("language", identify_language),
    ("near_dedup", deduplicate),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenization has no SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, through Parquet in the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
