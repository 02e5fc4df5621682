"""Pages as they arrive, micro-batch by micro-batch: the same slips as assigning all of them at once.

A page's place depends on the slips of its component: families that share a district, and districts that share a family.
A component is no fixed key, as a page may join two of them, so its state is not held by key in one operator but in
tables of the shared folder that each micro-batch reads and rewrites in part:

- `nodes` (node, comp): families and districts with the component each was in when it was last seen;
- `moved` (node, comp): names of components that were joined to another, with that one's name; these are few;
- `folded`: what each component holds, in buckets of its name, and in a bucket of their own (-1) the pages that a batch
  placed: where a batch put what, the slips it touched as they are now, and what it says of it are read from there;
- `failed`, `errors`, `results`: requests that failed, what is told of them, and what `evaluate` gave.

When a page joins components the slips of all move to the smallest name. A batch reads and rewrites only the buckets it
touches, and writes names only where they are new or changed. Its tables are named by its number and count once its log is
there, which is written last and holds the current batch of each bucket; a batch that runs again, whatever part of it had
been written, starts from the log before it and overwrites what it wrote. So a restarted query neither loses nor doubles a
page.

Arrivals are in order of ingest_seq within a batch, and batches follow each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyweave.operators.assign import FOLDED, base_of, fold_arrivals, page_rows
from tallyweave.operators.components import components
from tallyweave.tables import Scratch

NAMES = "node string, comp string"
FAILED = "request_id string, failed_at bigint"
LOG = "name string, bucket int, batch bigint"
EVENTS = "request_id string, seq bigint, event string, detail string"
#: The bucket of the pages that a batch placed.
_PLACED = -1


def states(slips: DataFrame) -> DataFrame:
    """(slip_key, voting_district, ballot_type, is_vote_related, expected, received, missing, status) of slips (SLIP)."""
    d = slips.withColumn("received", F.array_sort(F.filter("pages", lambda p: p.isNotNull())))
    wanted = F.when(F.col("expected") > 0, F.sequence(F.lit(1), F.col("expected"))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("missing", F.array_except(wanted, F.col("received")))
    status = F.when(F.size("missing") > 0, "incomplete").otherwise("pending_review")
    return d.select("slip_key", "voting_district", "ballot_type", "is_vote_related", "expected", "received", "missing", status.alias("status"))


class Arrivals:
    """The tables of one stream of pages in a folder of the shared store. `buckets` is fixed when the folder is new."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, evaluate: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.path, self.buckets, self.evaluate = spark, path.rstrip("/"), buckets, evaluate

    # Folders.

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target)

    def _log(self, batch: int) -> dict[tuple[str, int], int]:
        """(table, bucket) to the batch that wrote it last, after a batch; one row a bucket."""
        path = f"{self.path}/log/batch={batch}"
        if not self._exists(f"{path}/_SUCCESS"):
            return {}
        return {(r.name, r.bucket): r.batch for r in self.spark.read.schema(LOG).parquet(path).collect()}

    def _batches(self) -> list[int]:
        """The batches with a log, in order; numbers may start anywhere but follow each other without a gap."""
        path = f"{self.path}/log"
        if not self._exists(path):
            return []
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = [str(f.getPath().getName()) for f in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path))]
        done = sorted(int(n.partition("=")[2]) for n in found if n.startswith("batch="))
        return [n for n in done if self._exists(f"{path}/batch={n}/_SUCCESS")]

    def _bucket(self, name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def _paths(self, schema: str, paths: list[str]) -> DataFrame:
        paths = [p for p in paths if self._exists(p)]  # a bucket may be or have become empty
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema).where(F.lit(False))

    def _read(self, table: str, schema: str, buckets: list[int]) -> DataFrame:
        return self._paths(schema, [f"{self.path}/{table}/batch={self.log[table, b]}/bucket={b}" for b in buckets if (table, b) in self.log])

    def _dealt(self, name: Column) -> list[Column]:
        """By bucket, and each bucket among as many tasks as there are for it; a name goes to one."""
        tasks = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        return [self._bucket(name), F.pmod(F.shiftright(F.xxhash64(name), 32), F.lit(tasks))]

    def _write(self, table: str, rows: DataFrame, buckets: list[int], batch: int) -> None:
        """The buckets as they are from this batch on; rows have their bucket."""
        rows.write.partitionBy("bucket").option("compression", "zstd").mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")
        self.new |= {(table, b): batch for b in buckets}

    def _change(self, table: str, changed: DataFrame, batch: int) -> None:
        """Names (NAMES) that are new or have another component now."""
        places = self._touched(changed, "node")
        if places:
            rows = self._read(table, NAMES, places).join(changed.select("node"), "node", "left_anti").unionByName(changed)
            self._write(table, rows.repartition(*self._dealt(F.col("node"))).withColumn("bucket", self._bucket(F.col("node"))), places, batch)

    # Components.

    def _touched(self, rows: DataFrame, column: str) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(F.col(column))).distinct().collect()]  # at most `buckets` numbers

    def _known(self, pairs: DataFrame, scratch: Scratch) -> DataFrame:
        """pairs (base, site) with the components they were written in (base_was, site_was) and their names now (a, b)."""
        for node, kind, comp in (("base", "b", "a"), ("site", "s", "b")):
            held = self._read("nodes", NAMES, self._touched(pairs.where(F.col(node).isNotNull()), node)).where(F.col("node").startswith(kind))
            pairs = pairs.join(held.select(F.col("node").alias(node), F.col("comp").alias(f"{node}_was"), F.col("comp").alias(comp)), node, "left")
        pairs = scratch.cut(pairs, "known")
        while any(table == "moved" for table, _ in self.log):
            ups = []
            for comp in "ab":
                up = self._read("moved", NAMES, self._touched(pairs.where(F.col(comp).isNotNull()), comp))
                pairs = pairs.join(up.select(F.col("node").alias(comp), F.col("comp").alias(f"{comp}_up")), comp, "left")
                ups.append(F.col(f"{comp}_up").isNotNull())
                pairs = pairs.withColumn(comp, F.coalesce(f"{comp}_up", comp))
            pairs = scratch.cut(pairs.select("base", "site", "base_was", "site_was", "a", "b", (ups[0] | ups[1]).alias("up")), "known")
            if pairs.where("up").isEmpty():
                break
        return pairs.select("base", "site", "base_was", "site_was", "a", F.coalesce("b", "site").alias("b"))

    def _components(self, fine: DataFrame, batch: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
        """(base, comp) of the batch's families, and (node, comp) of components that are joined to another, if any are.

        A family lies with the components it and its districts are known in. Only where these are several, components
        are linked; a family without any is one by itself, and so is a new district until it is.
        """
        # A district is a node as well: its name can't be a family's.
        known_site = (F.coalesce(F.upper("voting_district"), F.lit("UNKNOWN")) != "UNKNOWN") & (F.col("voting_district") != "")
        site = F.when(known_site, F.concat(F.lit("s"), F.to_json(F.array("voting_district", "ballot_type"))))
        pairs = scratch.cut(fine.select(F.concat(F.lit("b"), "base").alias("base"), site.alias("site")).distinct(), "pairs")
        known = any(table == "nodes" for table, _ in self.log)
        none = F.lit(None).cast("string")
        per = self._known(pairs, scratch) if known else pairs.select("base", "site", none.alias("base_was"), none.alias("site_was"), none.alias("a"), F.col("site").alias("b"))
        bases = per.groupBy("base").agg(F.first("base_was").alias("was"), F.min(F.least("a", "b")).alias("low"), F.max(F.greatest("a", "b")).alias("high"))
        bases = scratch.cut(bases, "bases")
        several = bases.where("low < high").select("base", "low")
        links = per.join(several, "base").select("low", F.explode(F.array("a", "b")).alias("other")).where("low <> other").distinct()
        links = scratch.cut(links.select(F.col("low").alias("a"), F.col("other").alias("b")), "links")
        joined = None
        if not links.isEmpty():
            ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
            found = components(ids.select("id", F.col("id").alias("comp")), links, scratch)
            joined = scratch.cut(found.where("id <> comp").select(F.col("id").alias("node"), "comp"), "joined")

        def now(d: DataFrame) -> DataFrame:
            return d if joined is None else d.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")

        bases = now(bases.select("base", "was", F.coalesce("low", "base").alias("comp")))
        bases = scratch.cut(bases, "bases") if joined is not None else bases
        sites = now(per.where("site IS NOT NULL").select(F.col("site").alias("node"), F.col("site_was").alias("was"), F.col("b").alias("comp")))
        changed = F.col("was").isNull() | (F.col("was") != F.col("comp"))
        seen = bases.select(F.col("base").alias("node"), "was", "comp").where(changed).unionByName(sites.where(changed).distinct())
        seen = scratch.cut(seen, "seen")
        self._change("nodes", seen.select("node", "comp"), batch)
        if known:  # names that have been passed on lead straight to the last from now on
            gone = seen.where("was IS NOT NULL").select(F.col("was").alias("node"), "comp")
            self._change("moved", scratch.cut((gone if joined is None else gone.unionByName(joined)).distinct(), "gone"), batch)
        return bases.select(F.substring("base", 2, 1 << 30).alias("base"), "comp"), joined

    # A batch.

    def take(self, pages: DataFrame, batch: int) -> None:
        """Assigns a micro-batch of page records (PAGE_RECORDS), with an optional `error` text.

        A page with an error is not assigned; it and all later pages of its request (column request_id, if there is one)
        are told as events of a request that failed.
        """
        last = max((n for n in self._batches() if n < batch), default=None)
        self.log, self.new = self._log(last) if last is not None else {}, {}
        scratch = Scratch(self.spark)
        kept = ["ingest_seq", "voting_district", "ballot_type", "page_number", "page_total", "is_vote_related", *[c for c in ("request_id", "error") if c in pages.columns]]
        pages = scratch.cut(pages.select(base_of(F.col("slip_reference")).alias("base"), *kept), "pages")
        fine = self._without_failed(pages, batch, scratch)
        bases, joined = self._components(fine, batch, scratch)

        # Slips in all buckets that are touched; they move to the smallest name where components join.
        places = set(self._touched(bases, "comp"))
        if joined is not None:
            places |= set(self._touched(joined, "node"))
        held = self._read("folded", FOLDED, sorted(places))
        if joined is not None:
            to = joined.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            held = held.join(to, "comp", "left").withColumn("comp", F.coalesce("to", "comp"))
        held = held.withColumn("page_number", F.lit(None).cast("int"))
        rows = page_rows(fine.join(bases, "base"))
        folded = fold_arrivals(rows.unionByName(held.select(*rows.columns)), self._dealt(F.col("comp")))
        self._write("folded", folded.withColumn("bucket", F.when(F.col("is_page"), _PLACED).otherwise(self._bucket(F.col("comp")))), sorted(places), batch)

        self._tell(pages, batch)
        log = [(n, b, at) for (n, b), at in (self.log | self.new).items()]
        self.spark.createDataFrame(log, LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
        scratch.drop(*[t for t, _ in scratch.paths.values()])

    def _without_failed(self, pages: DataFrame, batch: int, scratch: Scratch) -> DataFrame:
        """Pages that come before the first error of their request, in this batch or before; one without a request stands
        alone."""
        error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
        pages = pages.withColumn("error", error)
        if "request_id" not in pages.columns:
            return pages.where("error IS NULL").drop("error")
        asked = pages.where("request_id IS NOT NULL")
        places = self._touched(asked, "request_id")
        held = self._read("failed", FAILED, places)
        bad = asked.where("error IS NOT NULL").select("request_id", F.col("ingest_seq").alias("failed_at")).unionByName(held)
        bad = scratch.cut(bad.groupBy("request_id").agg(F.min("failed_at").alias("failed_at")), "failed")
        asked = F.col("request_id")
        self._write("failed", bad.repartition(*self._dealt(asked)).withColumn("bucket", self._bucket(asked)), places, batch)
        return pages.join(bad, "request_id", "left").where("error IS NULL AND (failed_at IS NULL OR ingest_seq < failed_at)").drop("failed_at", "error")

    def _tell(self, pages: DataFrame, batch: int) -> None:
        """What a batch says beside its pages: errors, and what is made of the slips it touched."""
        if "error" in pages.columns:
            request = F.col("request_id") if "request_id" in pages.columns else F.lit(None).cast("string")
            wrong = pages.where("error IS NOT NULL").select(request.alias("request_id"), F.col("ingest_seq").alias("seq"), F.lit("error").alias("event"), F.col("error").alias("detail"))
            wrong.write.mode("overwrite").parquet(f"{self.path}/errors/batch={batch}")
        if self.evaluate is not None:
            self.evaluate(states(self._slips([batch]))).write.mode("overwrite").parquet(f"{self.path}/results/batch={batch}")

    # Results.

    def _slips(self, batches: list[int]) -> DataFrame:
        """The slips that batches touched, as they were after each."""
        return self._paths(FOLDED, [f"{self.path}/folded/batch={n}/bucket={b}" for n in batches for b in range(self.buckets)]).where("touched")

    def _placed(self) -> DataFrame:
        return self._paths(FOLDED, [f"{self.path}/folded/batch={n}/bucket={_PLACED}" for n in self._batches()])

    def assigned(self) -> DataFrame:
        """(ingest_seq, slip_key) of all batches that are done."""
        return self._placed().select(F.col("made").alias("ingest_seq"), "slip_key")

    def events(self) -> DataFrame:
        """(request_id, seq, event, detail), as progress.outcomes takes them: `page` with its slip, or `error`."""
        page = self._placed().select("request_id", F.col("made").alias("seq"), F.lit("page").alias("event"), F.col("slip_key").alias("detail"))
        return page.unionByName(self._paths(EVENTS, [f"{self.path}/errors/batch={n}" for n in self._batches()]))

    def results(self) -> DataFrame:
        """What `evaluate` gave for the slips each batch touched; without it the slips' states."""
        done = self._batches()
        if self.evaluate is None:
            return states(self._slips(done))
        return self.spark.read.parquet(*[f"{self.path}/results/batch={n}" for n in done])

    def states(self) -> DataFrame:
        """The state of each slip after the last batch."""
        last = max(self._batches(), default=None)
        self.log = self._log(last) if last is not None else {}
        return states(self._read("folded", FOLDED, sorted({b for t, b in self.log if t == "folded"})))

    def stream(self, pages: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A writer that takes a stream of page records into these tables."""
        return pages.writeStream.foreachBatch(lambda rows, batch: self.take(rows, batch)).option("checkpointLocation", checkpoint)


def upload_summary(events: DataFrame, times: DataFrame) -> DataFrame:
    """(request_id, processed_pages_count, affected_slips, total_elapsed_seconds, average_per_page_seconds, outcome) of
    events (request_id, seq, event, detail) and times (request_id, started_at, ended_at).

    An error ends a request; a request without pages counts as one page in the average.
    """
    d = events.groupBy("request_id").agg(F.count_if(F.col("event") == "page").alias("processed_pages_count"), F.array_sort(F.collect_set(F.when(F.col("event") == "page", F.col("detail")))).alias("affected_slips"), F.bool_or(F.col("event") == "error").alias("failed"))
    took = F.round(F.col("ended_at").cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double"), 3)
    d = times.join(d, "request_id", "left").withColumns({"processed_pages_count": F.coalesce("processed_pages_count", F.lit(0)), "total_elapsed_seconds": took})
    each = F.round(F.col("total_elapsed_seconds") / F.greatest(F.lit(1), F.col("processed_pages_count")), 3)
    return d.select("request_id", "processed_pages_count", F.coalesce("affected_slips", F.array().cast("array<string>")).alias("affected_slips"), "total_elapsed_seconds", each.alias("average_per_page_seconds"), F.when(F.coalesce("failed", F.lit(False)), "error").otherwise("complete").alias("outcome"))
