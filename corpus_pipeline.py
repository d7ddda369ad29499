"""A corpus pipeline of five stages, each applying one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import materialize
from driftline.llm.exact_dedup import exact_dedup
from driftline.llm.language_id import identify, learn_from_training_fold
from driftline.llm.mixing import mix_sources
from driftline.llm.near_dedup import near_dedup
from driftline.llm.pieces import encode_texts, load_model

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents without a language (no text, or no letter in it) go; all others stay.

    Which language a text is in rejects nothing.  Where nothing could be learned (no row of the training fold has a
    text and a language) letters alone decide.  Rows with a null or repeated id are documents like others; an
    empty table gives an empty result; extra columns of any name are carried along.
    """
    names = docs.columns
    own = docs.toDF(*[f"own_{i}" for i in range(len(names))])
    text = f"own_{names.index('text')}"
    model = learn_from_training_fold(docs)
    if not model.languages:
        return own.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).toDF(*names)
    return identify(own, model, text_col=text, keep=True).where("lang_pred <> 'und'").select(own.columns).toDF(*names)


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """(documents, name of a column that is unique, never null and in the order of doc_id, null ids last).

    Ids that are whole numbers, never null and never repeated are that key themselves.  Otherwise every row gets
    a number in the order of doc_id (rows of one id in the order of the input), written with the documents so
    that it is stable; the first number spreads rows of one id, or without any, over many tasks.
    """
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
            return docs, "doc_id"
    key = "row_key"
    while key in docs.columns:
        key += "_"
    numbered = docs.withColumn(key, F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), key)
    return materialize(numbered.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact deduplication: of texts equal but for white space one document stays, whatever ids are null or repeated.

    Null, empty and blank texts are equal; an empty table gives an empty result; extra columns of any name stay.
    """
    keyed, key = with_row_key(docs)
    kept = exact_dedup(keyed, id_col=key).where("kept").select(key)
    return keyed.join(kept, key, "left_semi").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates on five-word shingles at a similarity of 0.8: one document of each component stays.

    Rows with a null or repeated id are documents of their own, compared like all others; texts without words are
    near nothing and stay; an empty table gives an empty result; extra columns of any name stay.
    """
    keyed, key = with_row_key(docs)
    kept = near_dedup(keyed, id_col=key, shingle=5, percent=80).where("kept").select(key)
    return keyed.join(kept, key, "left_semi").select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source mixing: a document is repeated as often as the mix takes it, wholly or in part; untaken ones go.

    The part of a document at the end of its source's share counts as one more copy.  Rows with a null or
    repeated id are documents of their own; if there are any, the row numbers shuffle the streams, not the ids.
    A null source is one of its own; texts without words are never taken; an empty table gives an empty result;
    extra columns of any name stay.
    """
    keyed, key = with_row_key(docs)
    taken = mix_sources(keyed, id_col=key).where("taken > 0").select(key, F.ceil(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    repeated = taken.select(key, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(key)
    return keyed.join(repeated, key).select(docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: doc_id, ids, n_ids, n_byte_ids, round_trip for every row of the mix.

    A null text has null ids; null and repeated ids are kept; an empty table gives an empty result; extra columns
    of any name are left behind.
    """
    return encode_texts(docs, load_model(PIECES))


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mix", mixed_sources),
    ("encode", piece_ids),
]

#: Language models, similarity search and encoding have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
