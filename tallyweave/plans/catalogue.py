"""All queries and their oracles: those that call the operators (records.py, pages.py) and those that are one SQL shape,
text that both engines run as it is or a Spark form with its oracle."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.functions.scalars import register
from tallyweave.operators import assign, layout, slips, stats, store
from tallyweave.plans import pages, records
from tallyweave.streaming import arrivals, progress
from tallyweave.tables import Scratch, shared_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_PRED = "SELECT d.doc_id, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS predicted, CASE WHEN n_chars >= 800 THEN 1 ELSE 0 END AS other, lang, source FROM documents d"
_WIN = "(PARTITION BY user_id ORDER BY ts, event_id)"
_HINTS = "SELECT doc_id, lang, " + ", ".join(f"CASE WHEN contains(lower(text), ' {a} ') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), ' {b} ') THEN 1 ELSE 0 END AS {k}" for k, a, b in (("en", "the", "of"), ("fr", "les", "et"), ("de", "und", "der"), ("es", "los", "que"))) + " FROM documents"
_BEST = "CASE WHEN en >= greatest(fr, de, es) THEN 'en' WHEN fr >= greatest(de, es) THEN 'fr' WHEN de >= es THEN 'de' WHEN es >= 0 THEN 'es' END"

#: The same text for both engines.
SHARED: dict[str, str] = {
    "join_party_pages": "SELECT l_orderkey, l_linenumber, p_name, p_brand, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10",
    "slip_history": "SELECT event_id, user_id, event_type, c_name FROM events LEFT JOIN customer ON c_custkey = user_id WHERE user_id = 7",
    "turnout_pct": "SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN round(100 * CAST(q AS DOUBLE) / CAST(o_totalprice AS DOUBLE), 4) END AS pct FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey",
    "confidence_bucket": "SELECT CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1",
    "top1_newest_candidate": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) q WHERE r = 1",
    "newest_lacking_page": "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3) GROUP BY o_custkey",
    "prev_next_bands": f"SELECT event_id, (value + lag(value) OVER {_WIN}) / 2 AS lo, (value + lead(value) OVER {_WIN}) / 2 AS hi FROM events",
    "moving_avg3": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS avg3 FROM events",
    "ab_compare_pivot": f"SELECT source, count(CASE WHEN predicted = quality THEN 1 END) AS a, count(CASE WHEN other = quality THEN 1 END) AS b, CASE WHEN count(CASE WHEN predicted = quality THEN 1 END) > count(CASE WHEN other = quality THEN 1 END) THEN 'a' WHEN count(CASE WHEN predicted = quality THEN 1 END) < count(CASE WHEN other = quality THEN 1 END) THEN 'b' ELSE 'tie' END AS winner FROM labels l JOIN ({_PRED}) p ON p.doc_id = l.doc_id GROUP BY source",
    "files_of_two_runs": "SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1",
    # One row stays one row: the best of a few scores is a CASE, not a ranking.
    "layout_choice": f"SELECT doc_id, {_BEST} AS lang_hit FROM ({_HINTS}) h",
    "hint_score": f"SELECT lang, {_BEST} AS best, count(*) AS n, CAST(sum(CASE WHEN {_BEST} = lang THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM ({_HINTS}) h GROUP BY 1, 2",
    "result_slip_evidence": "SELECT doc_id, CASE WHEN (CASE WHEN contains(upper(text), 'LICENSE') THEN 1 ELSE 0 END) + (CASE WHEN contains(upper(text), 'RIGHTS') THEN 1 ELSE 0 END) + (CASE WHEN contains(upper(text), 'UNDER') THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE 0 END AS looks FROM documents",
    "conversation_pages": "SELECT conv_id, max(turn) + 1 AS expected, count(DISTINCT turn) AS received, max(turn) + 1 - count(DISTINCT turn) AS missing FROM conversations GROUP BY conv_id",
    "class_capped_sample": "SELECT quality, doc_id FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels) q WHERE r <= 20",
    "range_token_cells": "SELECT event_id, band FROM events JOIN (SELECT 1 AS band, 0.0 AS lo, 20.0 AS hi UNION ALL SELECT 2, 20.0, 50.0 UNION ALL SELECT 3, 50.0, 100.0) b ON value >= lo AND value < hi",
    "evidence_consensus": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, avg(value) DESC, max(value) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) q WHERE r = 1",
    "edit_distance_snap": "SELECT p_partkey, CASE WHEN levenshtein(p_brand, 'Brand#11') = 1 THEN 'Brand#11' WHEN levenshtein(p_brand, 'Brand#33') = 1 THEN 'Brand#33' END AS snapped FROM part",
    "gap_islands": "SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, max(value) AS peak FROM (SELECT user_id, value, sum(step) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (SELECT user_id, event_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) > 10 THEN 1 ELSE 0 END AS step FROM events) a) b GROUP BY user_id, island",
}


def _views(spark: SparkSession, d: str, text: str) -> None:
    """The tables that a text names as views, and the functions, once a session."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
    register(spark)


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        _views(spark, d, text)
        return spark.sql(text)

    return run


#: (Spark SQL, oracle SQL) where the engines spell things differently; None where an operator is called.
PAIRS: dict[str, tuple[str | None, str]] = {
    "first_n_codes": (
        "SELECT l_orderkey, array_join(slice(array_sort(collect_set(l_partkey)), 1, 5), ', ') AS codes FROM lineitem GROUP BY l_orderkey",
        "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey))[1:5], ', ') AS codes FROM lineitem GROUP BY l_orderkey",
    ),
    "latest_version_wins": (
        "SELECT user_id, event_type, max_by(value, struct(ts, event_id)) AS value FROM events GROUP BY user_id, event_type",
        "SELECT user_id, event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY user_id, event_type",
    ),
    "merge_first_last": (
        "SELECT user_id, min_by(event_type, struct(ts, event_id)) FILTER (WHERE event_type <> '') AS first_type, max(value) AS top, max_by(event_id, struct(ts, event_id)) FILTER (WHERE event_type = 'click') AS last_click FROM events GROUP BY user_id",
        "SELECT user_id, arg_min(event_type, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type <> '') AS first_type, max(value) AS top, arg_max(event_id, struct_pack(a := ts, b := event_id)) FILTER (WHERE event_type = 'click') AS last_click FROM events GROUP BY user_id",
    ),
    "carry_forward": (
        f"SELECT event_id, last(IF(event_type = 'click', value, NULL), true) OVER {_WIN[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM events",
        f"SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER {_WIN[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM events",
    ),
    "next_copy_number": (
        "SELECT l_orderkey, next_copy(collect_set(l_linenumber)) AS n FROM lineitem GROUP BY l_orderkey",
        "SELECT l_orderkey, CAST(list_min(list_filter(range(2, 10), lambda x: NOT list_contains(got, x))) AS INTEGER) AS n FROM (SELECT l_orderkey, list(l_linenumber) AS got FROM lineitem GROUP BY l_orderkey) q",
    ),
    "normalise_text_key": ("SELECT item_id, norm_key(text) AS k FROM benchmark", "SELECT item_id, regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'SS')), '[^A-Z0-9#]', '', 'g') AS k FROM benchmark"),
    "digits_last4": (
        "SELECT doc_id, vote_digits(text) AS v FROM documents",
        "SELECT doc_id, TRY_CAST(nullif(right(regexp_replace(translate(upper(coalesce(text, '')), 'ØÓODΦφIL', '00000011'), '[^0-9]', '', 'g'), 4), '') AS INTEGER) AS v FROM documents",
    ),
    "strip_copy_suffix": (
        "SELECT p_partkey, family_base(concat(p_name, ' (', p_size, ')')) AS base, copy_number(concat(p_name, ' (', p_size, ')')) AS n FROM part",
        "SELECT p_partkey, regexp_replace(p_name || ' (' || p_size || ')', '^(.*) \\([0-9]+\\)$', '\\1') AS base, p_size AS n FROM part",
    ),
    "page_marker_extract": (
        r"SELECT page_id, regexp_extract(url, 'page=([0-9]+)', 1) AS page, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages",
        r"SELECT page_id, regexp_extract(url, 'page=([0-9]+)', 1) AS page, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages",
    ),
    "json_config": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "eta_progress": (
        "SELECT event_id, round(remaining_s(value, CAST(event_id % 7 AS DOUBLE), 8D, 0.55D), 6) AS remaining, percent_done(CAST(event_id % 7 AS DOUBLE), 8D, 0.55D) AS pct FROM events",
        "SELECT event_id, round(greatest(0, value / (event_id % 7 + 0.55::DOUBLE) * (8 - event_id % 7 - 0.55::DOUBLE)), 6) AS remaining, CAST(round_even(100 * (event_id % 7 + 0.55::DOUBLE) / 8, 0) AS INTEGER) AS pct FROM events",
    ),
    "box_digits": (
        "SELECT l_orderkey, l_linenumber, l_partkey, box_votes(array(CAST(l_partkey % 10 AS INT), CAST(l_suppkey % 10 AS INT), NULL, NULL)).votes AS v FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_partkey % 10 = 0 THEN l_suppkey % 10 ELSE l_partkey % 10 * 10 + l_suppkey % 10 END AS INTEGER) AS v FROM lineitem",
    ),
    "nearest_row": (
        "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50), event_id) AS r FROM events) q WHERE r = 1",
        "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50), event_id) = 1",
    ),
    "event_sessions": (
        "SELECT user_id, date_format(w.start, 'yyyy-MM-dd HH:mm:ss') AS start, n FROM (SELECT user_id, session_window(CAST(ts AS TIMESTAMP), '2 hours') AS w, count(*) AS n FROM events GROUP BY 1, 2) q",
        "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS step FROM events) a) b GROUP BY user_id, island",
    ),
    # A row whose key and place are those of the row kept before it goes; sequential, so a fold within a user.
    "near_duplicate_rows": (
        "SELECT user_id, size(k) AS kept, k[size(k) - 1] AS last FROM (SELECT user_id, aggregate(array_sort(collect_list(value)), CAST(array() AS ARRAY<DOUBLE>), (k, v) -> IF(v - try_element_at(k, -1) < 12, k, concat(k, array(v)))) AS k FROM events GROUP BY user_id) q",
        "WITH RECURSIVE r(user_id, v, n) AS (SELECT user_id, min(value), 1 FROM events GROUP BY user_id UNION ALL SELECT r.user_id, (SELECT min(e.value) FROM events e WHERE e.user_id = r.user_id AND e.value - r.v >= 12), n + 1 FROM r WHERE v IS NOT NULL) SELECT user_id, CAST(max(n) AS INTEGER) AS kept, max(v) AS last FROM r WHERE v IS NOT NULL GROUP BY user_id",
    ),
    # No source of the training part is in the other; its rows count eightfold.
    "group_split_sample": (
        "SELECT doc_id, part, copy FROM (SELECT doc_id, IF(CAST(conv(left(md5(source), 2), 16, 10) AS INT) % 5 = 0, 'check', 'train') AS part FROM documents WHERE source IS NOT NULL) q LATERAL VIEW explode(sequence(1, IF(part = 'train', 8, 1))) x AS copy",
        "SELECT doc_id, part, CAST(unnest(range(1, CASE WHEN part = 'train' THEN 9 ELSE 2 END)) AS INTEGER) AS copy FROM (SELECT doc_id, CASE WHEN CAST(concat('0x', substring(md5(source), 1, 2)) AS INTEGER) % 5 = 0 THEN 'check' ELSE 'train' END AS part FROM documents WHERE source IS NOT NULL) q",
    ),
    "manifest_labels": (
        "SELECT m.doc_id, m.cell, m.label, l.quality AS gold FROM (SELECT doc_id, posexplode(array(CAST(n_chars % 10 AS INT), CAST(n_chars DIV 10 % 10 AS INT), NULL, 0)) AS (cell, label) FROM documents) m LEFT JOIN labels l ON l.doc_id = m.doc_id",
        "SELECT m.doc_id, CAST(cell AS INTEGER) AS cell, CAST(CASE cell WHEN 0 THEN n_chars % 10 WHEN 1 THEN n_chars // 10 % 10 WHEN 3 THEN 0 END AS INTEGER) AS label, l.quality AS gold FROM (SELECT doc_id, n_chars, unnest([0, 1, 2, 3]) AS cell FROM documents) m LEFT JOIN labels l ON l.doc_id = m.doc_id",
    ),
    "robust_stats": (
        None,
        "SELECT event_type, count(*) AS n, round(median(value), 6) AS med, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(stddev_pop(value) / avg(value), 6) AS cv, round(sum(value * (event_id % 5)) / sum(event_id % 5), 6) AS weighted FROM events GROUP BY event_type",
    ),
    "request_outcomes": (
        None,
        "SELECT user_id AS request_id, CASE WHEN count(CASE WHEN event_type = 'error' THEN 1 END) > 0 THEN 'error' WHEN count(CASE WHEN event_type = 'purchase' THEN 1 END) > 0 THEN 'complete' ELSE 'aborted' END AS outcome, CAST(min(event_id) FILTER (WHERE event_type = 'error') AS VARCHAR) AS detail FROM events GROUP BY user_id",
    ),
    "command_log_state": (
        None,
        """WITH e AS (SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_type = 'click') AS seg, max(event_id) FILTER (WHERE event_type = 'error') AS gone, max(event_id) FILTER (WHERE event_type = 'signup') AS made FROM events GROUP BY user_id)
        SELECT c_custkey AS id, coalesce(seg, c_mktsegment) AS segment, c_acctbal AS balance FROM customer LEFT JOIN e ON user_id = c_custkey WHERE gone IS NULL OR made > gone""",
    ),
    "stage_progress": (
        None,
        "SELECT event_id, 'reading' AS stage, value AS elapsed, event_id % 7 AS done, 8 AS total, 'progress' AS event, 'Reading the counts' AS message, round(greatest(0, value / (event_id % 7 + 0.55::DOUBLE) * (8 - event_id % 7 - 0.55::DOUBLE)), 6) AS remaining_seconds, CAST(round_even(100 * (event_id % 7 + 0.55::DOUBLE) / 8, 0) AS INTEGER) AS percent FROM events",
    ),
    "event_windows": (
        "SELECT date_format(w.start, 'yyyy-MM-dd HH:mm') AS start, event_type, n FROM (SELECT window(CAST(ts AS TIMESTAMP), '1 hour') AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2) q",
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
}


def _arriving(spark: SparkSession, d: str, ingest_seq: str) -> DataFrame:
    """Lines as arriving pages of their order's family, some of them in a district that families share; r is a line's place
    in its order by part and supplier."""
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))
    line = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("r", r)
    key = F.col("l_orderkey")
    district = F.when(key % 3 == 0, F.concat(F.lit("D"), (key / 9).cast("int").cast("string"))).otherwise(F.when(key % 3 == 1, "unknown"))
    page = {"page_number": F.col("l_linenumber").cast("int"), "page_total": F.lit(7), "is_vote_related": F.col("l_suppkey") % 11 != 0}
    return line.select("r", F.expr(ingest_seq).alias("ingest_seq"), key.cast("string").alias("slip_reference"), district.alias("voting_district"), F.lit("National").alias("ballot_type"), *[v.alias(k) for k, v in page.items()])


def _page_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Order after order."""
    return assign.assign_pages(_arriving(spark, d, "l_orderkey * 1000 + r").drop("r"))


def _arrival_stream(spark: SparkSession, d: str) -> DataFrame:
    """Round after round over all orders, in three micro-batches of a stream that is stopped after each."""
    scratch = Scratch(spark)
    pages = scratch.cut(_arriving(spark, d, "r * 1000000000000 + l_orderkey"), "pages")  # places in the order are found once
    folder = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    store = arrivals.Arrivals(spark, f"{folder}/state", buckets=16)
    for part in ("r <= 2", "r BETWEEN 3 AND 4", "r > 4"):
        pages.where(part).drop("r").write.option("compression", "zstd").mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schemas.PAGE_RECORDS).parquet(f"{folder}/in")
        store.stream(stream, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    scratch.drop(pages)
    return store.assigned()


def _assignment_sql(ingest_seq: str) -> str:
    """The fold as a recursion: step k places the k-th page of every component, whose slips are one list."""
    newest = "list_last(list_filter(range(1, len(slips) + 1), lambda i: slips[i].votes AND slips[i].{0} = {0} AND NOT list_contains(slips[i].pages, page)))"
    keys = "list_transform(slips, lambda s: s.key)"
    return f"""WITH RECURSIVE line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS r FROM lineitem),
      page AS (SELECT {ingest_seq} AS seq, CAST(l_orderkey AS VARCHAR) AS base, CASE WHEN l_orderkey % 3 = 0 THEN 'D' || l_orderkey // 9 END AS district, CAST(l_linenumber AS INTEGER) AS page, l_suppkey % 11 <> 0 AS votes FROM line),
      queue AS MATERIALIZED (SELECT *, coalesce(district, base) AS comp, row_number() OVER (PARTITION BY coalesce(district, base) ORDER BY seq) AS k FROM page),
      fold AS (
        SELECT comp, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(key VARCHAR, base VARCHAR, district VARCHAR, votes BOOLEAN, pages INTEGER[])[]) AS slips, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS slip_key FROM (SELECT DISTINCT comp FROM queue)
        UNION ALL
        SELECT comp, k, CASE WHEN hit IS NULL THEN list_append(slips, {{'key': fresh, 'base': base, 'district': district, 'votes': votes, 'pages': [page]}})
          ELSE list_transform(slips, lambda s, i: {{'key': s.key, 'base': s.base, 'district': s.district, 'votes': s.votes, 'pages': CASE WHEN i = hit THEN list_append(s.pages, page) ELSE s.pages END}}) END,
          seq, CASE WHEN hit IS NULL THEN fresh ELSE slips[hit].key END
        FROM (SELECT f.comp, q.k, q.seq, q.base, q.district, q.page, q.votes, f.slips, CASE WHEN q.votes THEN coalesce({newest.format("base")}, {newest.format("district")}) END AS hit,
            CASE WHEN NOT list_contains({keys}, base) THEN base WHEN q.votes THEN base || ' (' || list_first(list_filter(range(2, len(slips) + 3), lambda n: NOT list_contains({keys}, base || ' (' || n || ')'))) || ')' ELSE base || ' #' || q.seq END AS fresh
          FROM fold f JOIN queue q ON q.comp = f.comp AND q.k = f.k + 1) x)
      SELECT CAST(seq AS BIGINT) AS ingest_seq, slip_key FROM fold WHERE k > 0"""


def _replaced_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages with a row for each line, stored; then every seventh is replaced by a reading of fewer lines."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber <= 5")
    read = {"row_index": "CAST(l_linenumber AS INT)", "party_name": "concat('Party ', l_partkey)", "party_code": "concat('P', l_partkey % 12)", "votes": "CAST(l_quantity AS INT)", "confidence_score": "0.9D", "original_ocr_votes": "CAST(l_quantity AS INT)", "signature_detected": "l_linestatus = 'F'", "bbox": "CAST(NULL AS STRUCT<x: INT, y: INT, width: INT, height: INT>)"}
    row = F.struct(*[F.expr(v).alias(k) for k, v in read.items()])
    pages = lambda rows: rows.groupBy((F.col("l_orderkey") % 500).cast("string").alias("slip_id"), F.col("l_orderkey").cast("string").alias("page_id")).agg(F.array_sort(F.collect_list(row)).alias("party_results"))
    table = store.PartyTable(spark, f"{shared_dir(spark)}/party-{uuid.uuid4().hex}", 32)
    table.put(pages(line))
    table.put(pages(line.where("l_orderkey % 7 = 0 AND l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") + 1)))
    return table.rows().select("slip_id", "page_id", "row_index", "party_code", "votes", "is_overridden")


REPLACED = """SELECT CAST(l_orderkey % 500 AS VARCHAR) AS slip_id, CAST(l_orderkey AS VARCHAR) AS page_id, CAST(l_linenumber AS INTEGER) AS row_index, 'P' || l_partkey % 12 AS party_code, CAST(l_quantity AS INTEGER) + CASE WHEN again THEN 1 ELSE 0 END AS votes, false AS is_overridden
  FROM (SELECT *, l_orderkey % 7 = 0 AND min(l_linenumber) OVER (PARTITION BY l_orderkey) <= 2 AS again FROM lineitem WHERE l_linenumber <= 5) l WHERE NOT again OR l_linenumber <= 2"""


def _points_in_cells(spark: SparkSession, d: str) -> DataFrame:
    """Events as points, suppliers as cells of three sizes."""
    points = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "value AS x", "event_id * 7 % 100 AS y")
    k = "s_suppkey"
    cells = spark.read.parquet(f"{d}/supplier.parquet").selectExpr(k, f"{k} * 7 % 200 AS x1", f"{k} * 3 % 90 AS y1", f"{k} * 7 % 200 + CASE {k} % 20 WHEN 0 THEN 60 WHEN 1 THEN 0 ELSE 4 END AS x2", f"{k} * 3 % 90 + {k} % 4 AS y2")
    return layout.points_in_cells(points, cells, "x", "y", ("x1", "y1", "x2", "y2")).select("event_id", k)


def _projection_peaks(spark: SparkSession, d: str) -> DataFrame:
    """A user's events in order as a profile."""
    row = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    profile = spark.read.parquet(f"{d}/events.parquet").select("user_id", row.alias("y"), "value")
    return layout.peaks(profile, "user_id", "y", "value").select("user_id", F.array_join(F.col("peaks").cast("array<string>"), ",").alias("peaks"))


def _result_columns(spark: SparkSession, d: str) -> DataFrame:
    """A user's values as lines on a page a hundred wide."""
    lines = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("value").alias("x"), (F.col("event_id") * 13 % 50).alias("w"))
    found = layout.result_column(lines, "user_id", "x", "w", 100.0, 40.0)
    return found.select("user_id", F.round("score", 6).alias("score"), F.element_at("lines", 1).alias("left_x"), F.element_at("lines", 5).alias("right_x"))


#: A fold over a user's peaks in order: within the gap of the last one the higher of the two stays.
_FOLD = """SELECT {q}.user_id, {q}.k, CASE WHEN len(kept) = 0 OR {q}.y - kept[-1].y > {gap} THEN list_append(kept, {{'y': {q}.y, 's': {q}.s}}) WHEN {q}.s > kept[-1].s THEN list_append(kept[:len(kept) - 1], {{'y': {q}.y, 's': {q}.s}}) ELSE kept END
  FROM {f} JOIN {q} ON {q}.user_id = {f}.user_id AND {q}.k = {f}.k + 1"""
_NONE = "CAST([] AS STRUCT(y BIGINT, s DOUBLE)[])"
PEAKS = f"""WITH RECURSIVE raw AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS y, value AS v FROM events),
  smooth AS (SELECT *, coalesce(lag(v) OVER w, 0) / 3 + v / 3 + coalesce(lead(v) OVER w, 0) / 3 AS s FROM raw WINDOW w AS (PARTITION BY user_id ORDER BY y)),
  found AS (SELECT user_id, y, s FROM (SELECT *, lag(s) OVER w AS b, lead(s) OVER w AS a, max(s) OVER (PARTITION BY user_id) AS top FROM smooth WINDOW w AS (PARTITION BY user_id ORDER BY y)) WHERE s > top * 0.25::DOUBLE AND s >= b AND s >= a),
  one AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY y) AS k FROM found),
  f1 AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, {_NONE} AS kept FROM raw UNION ALL {_FOLD.format(q="one", f="f1", gap=6)}),
  e1 AS MATERIALIZED (SELECT user_id, arg_max(kept, k) AS kept FROM f1 GROUP BY user_id),
  g AS (SELECT *, list_filter(list_transform(range(2, len(kept) + 1), lambda i: kept[i].y - kept[i - 1].y), lambda d: d >= 16) AS rows FROM e1),
  apart AS (SELECT user_id, CASE WHEN len(kept) >= 4 AND len(rows) > 0 THEN greatest(7, CAST(round_even(list_aggregate(rows, 'median') * 0.35::DOUBLE, 0) AS INTEGER)) END AS gap FROM g),
  two AS MATERIALIZED (SELECT user_id, p.y AS y, p.s AS s, gap, row_number() OVER (PARTITION BY user_id ORDER BY p.y) AS k FROM (SELECT user_id, unnest(kept) AS p FROM e1) JOIN apart USING (user_id)),
  f2 AS (SELECT user_id, CAST(0 AS BIGINT) AS k, {_NONE} AS kept FROM e1 UNION ALL {_FOLD.format(q="two", f="f2", gap="coalesce(gap, 0)")}),
  e2 AS (SELECT user_id, arg_max(kept, k) AS kept FROM f2 GROUP BY user_id)
  SELECT user_id, array_to_string(list_transform(kept, lambda p: p.y), ',') AS peaks FROM e2"""
_X = "(a.x + b.x + c.x + d.x + e.x)"
_CV = "sqrt(((b.x - a.x - m) ** 2 + (c.x - b.x - m) ** 2 + (d.x - c.x - m) ** 2 + (e.x - d.x - m) ** 2) / 4) / m"
COLUMNS = f"""WITH line AS MATERIALIZED (SELECT user_id, x, w, row_number() OVER (PARTITION BY user_id ORDER BY x, w) AS i FROM (SELECT user_id, value AS x, event_id * 13 % 50 AS w FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id * 13 % 50 DESC, value) <= 24)),
  five AS (SELECT a.user_id, a.x AS left_x, e.x AS right_x, [a.x, b.x, c.x, d.x, e.x] AS xs, m, {_CV} AS cv, {_X} / 5 / 100 AS mid, least(1, a.w / 40) + least(1, b.w / 40) + least(1, c.w / 40) + least(1, d.w / 40) + least(1, e.w / 40) AS support
    FROM line a JOIN line e ON e.user_id = a.user_id AND e.i > a.i AND e.x - a.x BETWEEN 10 AND 26, LATERAL (SELECT (e.x - a.x) / 4 AS m) q, line b, line c, line d
    WHERE b.user_id = a.user_id AND c.user_id = a.user_id AND d.user_id = a.user_id AND b.i > a.i AND c.i > b.i AND d.i > c.i AND e.i > d.i),
  fit AS (SELECT f.*, (SELECT min(x) FROM line l WHERE l.user_id = f.user_id AND l.x > f.right_x + f.m * 0.35::DOUBLE) AS nxt FROM five f WHERE cv <= 0.35 AND mid BETWEEN 0.5 AND 0.82)
  SELECT user_id, round(score, 6) AS score, left_x, right_x FROM (SELECT *, 2.5::DOUBLE * (1 - cv) - abs((right_x - left_x) / 100 - 0.18::DOUBLE) * 2 - abs(mid - 0.68::DOUBLE) * 0.6::DOUBLE + least(1.5, coalesce(nxt - right_x, 100 - right_x) / m) * 0.5::DOUBLE + support / 5 * 0.3::DOUBLE AS score FROM fit)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, xs) = 1"""
CELLS = "SELECT event_id, s_suppkey FROM (SELECT event_id, value AS x, event_id * 7 % 100 AS y FROM events) e, supplier WHERE x BETWEEN s_suppkey * 7 % 200 AND s_suppkey * 7 % 200 + CASE s_suppkey % 20 WHEN 0 THEN 60 WHEN 1 THEN 0 ELSE 4 END AND y BETWEEN s_suppkey * 3 % 90 AND s_suppkey * 3 % 90 + s_suppkey % 4"


def _digit_fusion(spark: SparkSession, d: str) -> DataFrame:
    from tallyweave.functions.fusion import fuse

    line = spark.read.parquet(f"{d}/lineitem.parquet")
    out = fuse(line.selectExpr("l_orderkey", "l_linenumber", "CAST(l_partkey % 500 AS INT) AS icr", "0.8D AS icr_conf", "CAST((l_partkey * 13 + l_suppkey * 7) % 3000 AS INT) AS rapid", "0.5D + l_discount * 4 AS rapid_conf", "l_tax AS ink", "2000 AS registered"))
    return out.select("l_orderkey", "l_linenumber", "icr", "rapid", "votes", F.round("conf", 6).alias("conf"), "used_rapid")


def _command_log(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the events about them folded in as a command log: the latest value of each field wins."""
    state = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    e = spark.read.parquet(f"{d}/events.parquet")
    field = F.when(F.col("event_type") == "click", "segment").when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "created").otherwise("other")
    return slips.fold_commands(state, e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), field.alias("field"), F.col("event_type").alias("value")))


def _progress(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    out = progress.progress(e.select("event_id", F.lit("reading").alias("stage"), F.col("value").alias("elapsed"), (F.col("event_id") % 7).alias("done"), F.lit(8).alias("total")))
    return out.withColumn("remaining_seconds", F.round("remaining_seconds", 6))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    event = F.when(F.col("event_type") == "purchase", "complete").otherwise(F.col("event_type"))
    return progress.outcomes(e.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), event.alias("event"), F.col("event_id").cast("string").alias("detail")))


def _robust(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("w", F.col("event_id") % 5)
    out = stats.summaries(e, "event_type", "value", "w")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("med", "mean", "sd", "cv", "weighted")])


#: The fusion as the other engine has it: (when, votes, confidence, whether the second reader's).
_FUSED = [
    ("b AND r = i AND i > 0", "i", "least(0.93, (ic + rc) / 2 + 0.06)", 0), ("b AND i > 0 AND noisy", "i", "least(ic, 0.7)", 0), ("io AND i >= 100 AND ro AND (suffix(si, sr) OR prefix(si, sr)) AND li > lr", "i", "ic", 0),
    ("io AND i >= 100 AND ro AND r BETWEEN 1 AND 99", "r", "least(0.88, rc)", 1), ("io AND i >= 100 AND ro AND lr >= 3", "i", "ic", 0), ("io AND i >= 100", "0", "least(ic, 0.4)", 0), ("ro AND r > 0 AND i = 0 AND ink >= 0.01 AND rc >= 0.75 AND lr <= 2", "r", "least(0.88, greatest(rc, 0.7))", 1),
    ("ro AND r > 0 AND i = 0 AND lr = 3", "0", "greatest(ic, 0.55)", 0), ("ro AND r > 0 AND i = 0 AND lr = 4 AND rc >= 0.85", "r", "least(0.88, rc)", 1), ("d AND suffix(si, sr) AND li > lr", "i", "ic", 0), ("d AND lr = li + 1 AND li >= 2 AND prefix(sr, si) AND r % 10 = 1 AND rc >= 0.64", "r", "least(0.88, rc)", 1),
    ("d AND lr = 3 AND li = 2 AND i % 10 = 0 AND r % 10 <> 0 AND rc >= 0.64", "r % 100", "least(0.88, rc)", 1), ("d AND lr = li + 1 AND li >= 2", "i", "least(ic, 0.7)", 0), ("d AND lr = 2 AND li = 1 AND rc >= 0.64", "r", "least(0.88, rc)", 1), ("d AND lr = 3 AND li = 1", "i", "least(ic, 0.7)", 0),
    ("d AND lr > li AND rc >= 0.85", "r", "least(0.88, rc)", 1), ("d AND i = 9 AND r IN (3, 4, 7)", "i", "ic", 0), ("d AND lr = li AND li <= 2 AND rc >= 0.85", "r", "least(0.88, rc)", 1), ("d AND lr = li AND i % 10 = 0 AND r % 10 <> 0 AND rc >= 0.64", "r", "least(0.88, rc)", 1), ("d", "i", "ic", 0),
    ("ro AND r > 0 AND rc >= 0.85 AND NOT io", "r", "least(0.88, rc)", 1), ("io AND (i > 0 OR NOT ro)", "i", "ic", 0), ("ro", "r", "least(0.7, greatest(rc, 0.45))", 1), ("true", "0", "greatest(ic, 0.55)", 0),
]
_ONES = "length({0}) - length(replace({0}, '{1}', ''))"
_DIGIT = "list_filter(range(1, length(sr) + 1), lambda p: left(sr, p - 1) || substring(sr, p + 1) = si AND (substring(sr, p, 1) IN ('1', '8') AND NOT (p = length(sr) AND prefix(sr, si)) OR substring(sr, p, 1) IN ('3', '7', '9') AND p = 1 OR substring(sr, p, 1) NOT IN ('1', '8') AND contains(si, substring(sr, p, 1))))"
FUSION = f"""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 500 AS INT) AS i, 0.8::DOUBLE AS ic, CAST((l_partkey * 13 + l_suppkey * 7) % 3000 AS INT) AS rapid, 0.5::DOUBLE + l_discount * 4 AS rc, l_tax AS ink FROM lineitem),
  p AS (SELECT *, regexp_replace(regexp_replace(CAST(rapid AS STRING), '^[12]+(..)', '\\1'), '^0+(.)', '\\1') AS peeled FROM x),
  q AS (SELECT *, CASE WHEN rapid >= 1000 AND regexp_matches(CAST(rapid AS STRING), '^21[089]') THEN CAST(left(CAST(rapid AS STRING), 1) || right(CAST(rapid AS STRING), 1) AS INT) WHEN rapid >= 1000 AND regexp_matches(peeled, '^([0-7][0-9]|[0-9])$') AND regexp_matches(CAST(rapid AS STRING), '^[12]') THEN CAST(peeled AS INT) ELSE rapid END AS r FROM p),
  s AS (SELECT *, CAST(i AS STRING) AS si, CAST(r AS STRING) AS sr, length(CAST(i AS STRING)) AS li, length(CAST(r AS STRING)) AS lr, i <= 2000 AS io FROM q),
  n AS (SELECT *, r <= 2000 AND rc >= 0.55 AND NOT (r > 1 AND (regexp_matches(sr, '^1{{2,4}}$') OR r >= 100 AND length(replace(sr, '1', '')) <= 1 OR lr = 4 AND {_ONES.format("sr", 1)} >= 2 AND {_ONES.format("sr", 0)} >= 2 OR regexp_matches(sr, '^[12]{{4}}$') OR regexp_matches(sr, '^[0389]{{3,}}$'))) AS ro,
    r > 0 AND i > 0 AND (lr > li AND (replace(sr, '1', '') = si AND (length(replace(sr, '1', '')) <= lr - 2 - ({_ONES.format("si", 1)}) OR prefix(sr, '1') AND NOT prefix(si, '1')) OR suffix(sr, si) AND regexp_matches(left(sr, lr - li), '^1+$')) OR lr = li + 1 AND len({_DIGIT}) > 0) AS noisy FROM s),
  f AS (SELECT *, io AND ro AS b, io AND ro AND r <> i AND i > 0 AS d FROM n)
  SELECT l_orderkey, l_linenumber, i AS icr, rapid, CAST(CASE {" ".join(f"WHEN {w} THEN {v}" for w, v, _, _ in _FUSED)} END AS INTEGER) AS votes, round(CASE {" ".join(f"WHEN {w} THEN {c}" for w, _, c, _ in _FUSED)} END, 6) AS conf, CASE {" ".join(f"WHEN {w} THEN {u} = 1" for w, _, _, u in _FUSED)} END AS used_rapid FROM f"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = dict(records.queries()) | pages.queries()
    out |= {k: _sql(v) for k, v in SHARED.items()} | {k: _sql(v[0]) for k, v in PAIRS.items() if v[0]}
    return out | {"page_assignment": _page_assignment, "arrival_stream": _arrival_stream, "points_in_cells": _points_in_cells, "replaced_party_rows": _replaced_rows, "projection_peaks": _projection_peaks, "result_columns": _result_columns, "digit_fusion": _digit_fusion, "command_log_state": _command_log, "stage_progress": _progress, "request_outcomes": _outcomes, "robust_stats": _robust}


def oracle_sql() -> dict[str, str]:
    return records.oracle_sql() | pages.oracle_sql() | SHARED | {"digit_fusion": FUSION, "points_in_cells": CELLS, "replaced_party_rows": REPLACED, "projection_peaks": PEAKS, "result_columns": COLUMNS, "page_assignment": _assignment_sql("l_orderkey * 1000 + r"), "arrival_stream": _assignment_sql("r * 1000000000000 + l_orderkey")} | {k: v[1] for k, v in PAIRS.items()}
