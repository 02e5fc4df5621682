"""Stored tables that change in place: party rows by page, slips by status, a partition at a time.

Party rows lie in partitions by a hash of their slip, slips in one for each status, so a status is read without looking at
the others. A change rewrites the partitions it touches and no others: what stays in them and what is new is written to the
shared folder first, as a table can't be read while it is overwritten, and then takes their place. A change that is done
again, after an executor or the driver was lost, gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.schemas import PARTY_RESULTS
from tallyweave.tables import Scratch

#: What a record has of a row: the page's slip and number are the page's.
READ = "array<struct<row_index:int,party_name:string,party_code:string,votes:int,confidence_score:double,original_ocr_votes:int,signature_detected:boolean,bbox:struct<x:int,y:int,width:int,height:int>>>"


def party_rows(records: DataFrame) -> DataFrame:
    """(PARTY_RESULTS) of page records (slip_id, page_id, party_results array): a row for each row that was read, not
    overridden. Its id is the page's with its place, so a record that comes twice has the same rows. Null counts as none."""
    rows = records.select("slip_id", "page_id", F.posexplode(F.col("party_results").cast(READ)).alias("i", "r"))
    fixed = {"id": F.concat("page_id", F.lit("/"), F.col("i").cast("string")), "is_overridden": F.lit(False), "overridden_by": F.lit(None).cast("string")}
    names = [c.split(" ")[0] for c in PARTY_RESULTS.split(", ")]
    return rows.select(*[fixed[n].alias(n) if n in fixed else F.col(n) if n in ("slip_id", "page_id") else F.col(f"r.{n}").alias(n) for n in names])


class Stored:
    """A table in a folder, partitioned by a column; each change rewrites the partitions it names."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str) -> None:
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, by

    def read(self) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def rewrite(self, rows: DataFrame, parts: list) -> None:
        """The named partitions hold these rows, all of them theirs, from now on; an empty one is removed."""
        scratch = Scratch(self.spark)
        staged = scratch.cut(rows, "rewrite")
        staged.repartition(self.by).write.partitionBy(self.by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        left = {r[0] for r in staged.select(self.by).distinct().collect()}
        for part in set(parts) - left:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.by}={part}")
            target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        scratch.drop(staged)


class PartyTable:
    """Party rows by slip; pages come in, and a replaced page takes its rows along."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64) -> None:
        self.parts, self.table = parts, Stored(spark, path, f"{PARTY_RESULTS}, part int", "part")

    def rows(self) -> DataFrame:
        return self.table.read().drop("part")

    def of_slip(self, slip: str) -> DataFrame:
        """The rows of one slip, from its partition alone."""
        part = self.table.spark.range(1).select(F.pmod(F.xxhash64(F.lit(slip)), F.lit(self.parts))).first()[0]
        return self.table.read().where((F.col("part") == int(part)) & (F.col("slip_id") == slip)).drop("part")

    def put(self, records: DataFrame) -> list[int]:
        """Adds pages, or replaces those that are there, which stay on their slip; gives the partitions rewritten.

        A page's rows go as a whole, whether or not new ones were read: records have (slip_id, page_id, party_results).
        """
        part = F.pmod(F.xxhash64("slip_id"), F.lit(self.parts)).cast("int").alias("part")
        pages = records.select("page_id", part)
        touched = sorted(r[0] for r in pages.select("part").distinct().collect())  # at most `parts` numbers
        kept = self.table.read().where(F.col("part").isin(touched)).join(pages.select("page_id").distinct(), "page_id", "left_anti")
        new = party_rows(records)
        self.table.rewrite(kept.select(*new.columns, "part").unionByName(new.select("*", part)), touched)
        return touched


class SlipTable:
    """Slips by status: lists of one status and the approved slips of a district read one partition."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.table = Stored(spark, path, schema, "status")

    def of_status(self, *statuses: str) -> DataFrame:
        return self.table.read().where(F.col("status").isin(*statuses))

    def put(self, slips: DataFrame) -> list[str]:
        """Slips as they are now take the place of what the table holds of them, in whatever status that was."""
        ids = slips.select("id").distinct()
        was = self.table.read().join(ids, "id", "left_semi").select("status")
        touched = sorted({r[0] for r in was.union(slips.select("status")).distinct().collect()})  # the statuses there are
        kept = self.table.read().where(F.col("status").isin(touched)).join(ids, "id", "left_anti")
        self.table.rewrite(kept.unionByName(slips.select(kept.columns)), touched)
        return touched


def seeded_over(table: DataFrame, seed: DataFrame, key: str, over: list[str]) -> DataFrame:
    """The table with a seed: its rows are added, and where the key is there the columns `over` take the seed's values."""
    s = seed.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in over], F.lit(True).alias("__hit"))
    d = table.join(F.broadcast(s), key, "left")  # a seed is a fixed list
    d = d.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in over}).select(table.columns)
    return d.unionByName(seed.join(table.select(key), key, "left_anti").select(table.columns))
