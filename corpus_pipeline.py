"""The training-data pipeline over documents: language ID, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexmill.llm import decontaminate, langid, pii
from lexmill.llm.bpe import Tokenizer
from lexmill.llm.near_dedup import near_duplicates
from lexmill.llm.queries import vocabulary
from lexmill.session import delete_path, materialize, scratch_path, scratch_scope


#: Row keys that may be broadcast.
BROADCAST_ROWS = 500_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier rejects go. It learns from the stage's own labelled rows; without any, all are rejected."""
    model = langid.train(docs)
    found = langid.predict(docs, model, F.col("text"))
    return docs.withColumn("__language", found).where(~F.col("__language.rejected")).drop("__language")


def _row_key(docs: DataFrame) -> Column:
    """Id and 128-bit digest of the text, in the order of ids: rows of one key are equal in both. A null id is the last."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):  # eight bytes whose order is that of the numbers
        number = F.unhex(F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    else:
        number = F.encode(F.col("doc_id").cast("string"), "UTF-8")
    digest = F.when(F.col("text").isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.md5("text")))
    return F.concat(F.coalesce(F.concat(F.unhex(F.lit("00")), number), F.unhex(F.lit("01"))), digest)


def _few(keys: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows (keys of some 40 bytes) are few; beyond, the join shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays; of rows equal in id and text, one. Rows that share an id, or have none, are
    told apart by their texts. Texts move only where a row is repeated: others stay or go by the keys of those that go."""
    keyed = docs.withColumn("__row", _row_key(docs))
    found = near_duplicates(keyed, id_col="__row").groupBy(F.col("doc_id").alias("__row")).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    found = materialize(found.where("NOT kept OR n > 1"), "found")
    once = keyed.join(_few(found.select("__row")), "__row", "left_anti")
    repeated = keyed.join(_few(found.where("kept").select("__row")), "__row", "left_semi").dropDuplicates(["__row"])
    return once.unionByName(repeated).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, and no others that share their id."""
    keyed = docs.withColumn("__row", _row_key(docs))
    found = decontaminate.matches(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__row").select(F.col("doc_id").alias("__row")).distinct()
    return keyed.join(_few(materialize(found, "found")), "__row", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts gives way to its kind, and n_chars follows."""
    columns = docs.columns
    found = docs.withColumn("text", pii.redacted(F.col("text")))
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as ids, and whether they decode to the text again."""
    tokenizer = Tokenizer(spark, vocabulary())
    encoded = docs.select("doc_id", "text", tokenizer.encode(F.col("text")).alias("ids"))
    decoded = encoded.select("doc_id", "text", "ids", tokenizer.decode(F.col("ids")).alias("decoded"))
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")).cast("binary"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]
#: SQL can express neither the trained stages nor the tokenizer. Tests hold near-duplicates against all pairs, decontamination against all
#: windows, base spans against regular expressions, ids against the tiktoken library, and languages against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage writes for itself is deleted when it has ended, its result when the next has."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
