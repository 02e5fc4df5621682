"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import crf_langid, minhash, packing, pii, substring
from tallyweave.llm.common import read, rows_with_key, slices
from tallyweave.tables import Scratch

#: Ids that are sent to every task (8 MB); more meet the rows by a shuffle.
FEW = 1 << 20
#: Bytes of texts that pass between Spark and Python at once, in all stages; the default is 64 MB for each task and way.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... so that no two names clash, and which is which; of names that differ by case alone the
    exact one counts."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (columns by place) under their names, with n_chars, if there is one, of the text as it is now."""
    d, at = docs.toDF(*(f"c{i}" for i in range(len(columns)))), {n: f"c{i}" for i, n in enumerate(columns)}
    if "n_chars" in at:
        d = d.withColumn(at["n_chars"], F.length(at["text"]).cast("long"))
    return d.toDF(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language is settled: a mean probability of at least a half. Each row is judged
    by its own text, whether its id is null, repeated or neither; a null, empty or letterless text goes. Other columns
    pass, whatever their names; an empty table gives an empty one."""
    spark.conf.set(*BATCH)
    d, at = _plain(docs)
    rows = d.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), F.struct(*d.columns).alias("row"))
    found = crf_langid.predict(rows, crf_langid.learn(docs), keep="row").where("lang_pred <> 'und' AND score >= 0.5")
    return found.select("row.*").toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest id, of each group of near-duplicates. Rows that repeat an id are documents of
    their own, of which one is kept; a row with a null id is kept and takes no other's place; so is a null or blank text,
    which is like no other. Other columns pass, whatever their names; an empty table gives an empty one."""
    rows, unpack = rows_with_key(docs, "doc_id", "text")
    found = minhash.near_duplicates(rows.where("key IS NOT NULL").select("key", "text"), id_col="key")
    gone = found.where("NOT kept").select("key")
    return unpack(rows.join(F.broadcast(gone) if gone.count() <= FEW else gone, "key", "left_anti")).toDF(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that an earlier document holds out of later ones; what is left empty goes. Rows that repeat an id
    are documents of their own; a row with a null id or text stays as it is. Other columns pass, whatever their names; an
    empty table gives an empty one."""
    d, at = _plain(_sized(substring.remove(docs), docs.columns))
    return d.where(F.col(at["text"]).isNull() | (F.col(at["text"]) != "")).toDF(*docs.columns)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind in each row's text, null and empty ones staying as they are. Ids and
    other columns pass, whatever their names; an empty table gives an empty one."""
    d, at = _plain(docs)
    names, text = d.columns, d.columns.index(at["text"])

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            new = pa.array([t and pii.redact(t) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == text else c for i, c in enumerate(b.columns)], names)

    return _sized(d.mapInArrow(run, d.schema), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences: a null text packs as an empty one, rows that repeat as often as
    they occur, an empty table gives an empty one; other columns are not looked at."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near), ("repeated_passages", repeats), ("personal_data", personal), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, after the five stages. Each stage's table is written, reread as the next
    one's documents, and removed once that is written; what a stage writes for itself it removes but for its result."""
    scratch, docs, old = Scratch(spark), read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        scratch.drop(old)
        old = docs
    return docs
