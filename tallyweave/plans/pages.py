"""Page text to record over the driver's tables: pages are written from orders and lines, in several spellings, and read
back; an oracle states the values that went in, so it shares nothing with the reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import forms

_N = "CAST(o_orderkey % 9000 + 100 AS INT)"
#: A page's lines: labels in one line or two, digits apart, look-alike letters.
LINES = f"""SELECT o_orderkey AS k, array('ELECTORAL COMMISSION', IF(o_orderkey % 3 = 0, 'province of FREE STATE', IF(o_orderkey % 3 = 1, 'GAUTENG', 'no place')), concat('NMA', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), ' - Port Town VD ', lpad(CAST(o_custkey AS STRING), 8, '0')),
  concat('Green Lane ', CAST(o_custkey % 7 AS STRING)), IF(o_orderkey % 2 = 0, concat('Registered Voters: ', CAST({_N} AS STRING)), 'Registered Voters'), IF(o_orderkey % 2 = 0, '', concat('of this place ', CAST({_N} AS STRING))), 'PRESIDING OFFICER NAME: JANE ROE SIGNATURE',
  concat('TOTAL VALID VOTES CAST: ', CAST({_N} AS STRING)), IF(o_orderkey % 4 = 0, 'TOTAL NUMBER OF SPOILT O 7', 'SPOILT RESULTS 12'), 'TOTAL VOTES CAST 5', concat('and then TOTAL VOTES CAST ', CAST({_N} + 7 AS STRING)), 'then', IF(o_orderkey % 5 = 0, '24A 3', 'SECTION 24A 4'), concat('Page ', CAST(o_orderkey % 3 + 1 AS STRING), ' of 3')) AS lines FROM orders"""
#: A token of a given text, place and size.
_ITEM = "named_struct('text', {t}, 'score', CAST({s} AS DOUBLE), 'cx', CAST({x} AS DOUBLE), 'cy', CAST({y} AS DOUBLE), 'x1', CAST({x} - 10 AS DOUBLE), 'x2', CAST({x} + 10 AS DOUBLE), 'y1', CAST({y} - 6 AS DOUBLE), 'y2', CAST({y} + 6 AS DOUBLE))"


def _item(t: str, x: str, y: str, s: str = "0.8D") -> str:
    return _ITEM.format(t=t, x=x, y=y, s=s)


#: (table, Spark expressions, oracle over the same table)
QUERIES: dict[str, tuple[str, str, str]] = {
    "page_location": (
        f"({LINES})",
        "k, x.province, x.municipality, x.voting_district, x.registered_voters, x.station_name, x.officer FROM (SELECT k, location_of(lines, array('Free State', 'Gauteng')) AS x FROM {t})",
        f"SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Free State' WHEN 1 THEN 'Gauteng' END AS province, concat('NMA', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), ' - Port Town') AS municipality, lpad(CAST(o_custkey AS STRING), 8, '0') AS voting_district, {_N} AS registered_voters, concat('GREEN LANE ', CAST(o_custkey % 7 AS STRING)) AS station_name, 'JANE ROE' AS officer FROM orders",
    ),
    "page_totals": (
        f"({LINES})",
        "k, x.valid, x.spoilt, x.cast AS cast_votes, x.special, x.s24a FROM (SELECT k, totals_of(lines) AS x FROM {t})",
        f"SELECT o_orderkey AS k, {_N} AS valid, CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE 12 END AS spoilt, {_N} + 7 AS cast_votes, CAST(NULL AS INTEGER) AS special, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 4 END AS s24a FROM orders",
    ),
    "page_number": (f"({LINES})", "k, x.n, x.total FROM (SELECT k, page_marker(array_join(lines, ' ')) AS x FROM {t})", "SELECT o_orderkey AS k, CAST(o_orderkey % 3 + 1 AS INTEGER) AS n, 3 AS total FROM orders"),
    "page_evidence": (
        f"({LINES})",
        "k, looks_like_slip(slice(lines, 1, CAST(k % 12 AS INT)), k % 50 = 0, IF(k % 7 = 0, 'UNKNOWN', ''), 2) AS slip, looks_like_slip(array('nothing'), false, IF(k % 2 = 0, '12345678', ' unknown '), 0) AS by_district FROM {t}",
        "SELECT o_orderkey AS k, o_orderkey % 50 = 0 OR CASE WHEN o_orderkey % 12 < 7 THEN 1 WHEN o_orderkey % 12 < 8 THEN 2 ELSE 3 END - CASE WHEN o_orderkey % 12 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 12 >= 5 AND o_orderkey % 2 = 0 OR o_orderkey % 12 >= 5 AND o_orderkey % 2 = 1 THEN 1 ELSE 0 END >= 2 AS slip, o_orderkey % 2 = 0 AS by_district FROM orders",
    ),
    "form_class": (
        "orders",
        "o_orderkey AS k, x.family, x.ballot_type, x.reason FROM (SELECT o_orderkey, classify_form(array(element_at(array('a district council pr form', 'ward ballot', 'PR ballot', 'ec test party', 'national ballot', 'result slip', 'none'), CAST(o_orderkey % 7 + 1 AS INT)), 'x'), o_orderkey % 7 = 6 AND o_orderkey % 2 = 0, IF(o_orderkey % 3 = 0, 'Ward', NULL)) AS x FROM {t})",
        """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 < 4 OR o_orderkey % 7 = 6 AND o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'lg2026' ELSE 'iec2024' END AS family, CASE o_orderkey % 7 WHEN 0 THEN 'District Council PR' WHEN 1 THEN 'Ward' WHEN 2 THEN 'Local Council PR' WHEN 3 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Ward' ELSE 'District Council PR' END WHEN 6 THEN CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'Ward' END END AS ballot_type,
        CASE WHEN o_orderkey % 7 < 3 THEN 'title' WHEN o_orderkey % 7 = 3 THEN 'test_party' WHEN o_orderkey % 7 < 6 THEN 'iec_title' WHEN o_orderkey % 2 = 0 THEN 'result_grid' WHEN o_orderkey % 3 = 0 THEN 'colour_bar' ELSE 'default_iec' END AS reason FROM orders""",
    ),
    "page_identity": (
        "orders",
        "k, x.voting_district, x.registered_voters, x.municipality, x.province, x.officer, x.page.n AS n FROM (SELECT o_orderkey AS k, identity_of(array(concat('VD: ', lpad(CAST(o_custkey AS STRING), 8, '0')), IF(o_orderkey % 2 = 0, 'DC22 - uMgungundlovu Ward 3', 'KZN225 – Pieter Town Voting'), concat('Registered Voters ', CAST(o_custkey % 900 + 10 AS STRING)), 'Name of Counting Officer: Jo Roe Signature', concat('Page ', CAST(o_orderkey % 2 + 1 AS STRING), ' of 2'))) AS x FROM {t})",
        "SELECT o_orderkey AS k, lpad(CAST(o_custkey AS STRING), 8, '0') AS voting_district, CAST(o_custkey % 900 + 10 AS INTEGER) AS registered_voters, CASE WHEN o_orderkey % 2 = 0 THEN 'DC22 - uMgungundlovu' ELSE 'KZN225 - Pieter Town' END AS municipality, 'KwaZulu-Natal' AS province, 'Jo Roe' AS officer, CAST(o_orderkey % 2 + 1 AS INTEGER) AS n FROM orders",
    ),
    "barcode_tokens": (
        "orders",
        "o_orderkey AS k, p.voting_district, p.ballot_type, p.page_number, p.page_total FROM (SELECT o_orderkey, barcode_parts(barcode_of(array('no 12', IF(o_orderkey % 4 = 0, 'none', concat('8013 3', lpad(CAST(o_custkey AS STRING), 9, '0'), CAST(o_orderkey % 3 + 1 AS STRING), '02 1'))), array('0011', concat('33', lpad(CAST(o_custkey AS STRING), 8, '0')), '1031'), IF(o_orderkey % 5 = 0, '76240234', NULL), NULL)) AS p FROM {t})",
        "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN '76240234' ELSE lpad(CAST(o_custkey AS STRING), 8, '0') END AS voting_district, CASE WHEN o_orderkey % 4 = 0 THEN 'National' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'National' WHEN 1 THEN 'Provincial' ELSE 'Regional' END END AS ballot_type, CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 2 END AS page_number, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 3 ELSE 2 END AS page_total FROM orders",
    ),
    "local_barcodes": (
        "orders",
        "o_orderkey AS k, p.slip_reference, p.prefix, p.voting_district, p.ballot_type, p.ballot_type_code, p.page_number, p.page_total FROM (SELECT o_orderkey, barcode_parts(barcode_hit(concat('011965', lpad(CAST(o_custkey AS STRING), 8, '0'), CAST(o_orderkey % 5 + 2 AS STRING), '0', CAST(o_orderkey % 2 + 1 AS STRING), '2'), 'lg2026'), 'lg2026') AS p FROM {t})",
        "SELECT o_orderkey AS k, CASE WHEN c IN (3, 4, 6) THEN '011965' || vd || c END AS slip_reference, CASE WHEN c IN (3, 4, 6) THEN '011965' END AS prefix, CASE WHEN c IN (3, 4, 6) THEN vd END AS voting_district, CASE c WHEN 3 THEN 'Local Council PR' WHEN 4 THEN 'Ward' WHEN 6 THEN 'District Council PR' END AS ballot_type, CASE WHEN c IN (3, 4, 6) THEN CAST(c AS VARCHAR) END AS ballot_type_code, CASE WHEN c IN (3, 4, 6) THEN CAST(o_orderkey % 2 + 1 AS INTEGER) END AS page_number, CASE WHEN c IN (3, 4, 6) THEN 2 END AS page_total FROM (SELECT o_orderkey, o_orderkey % 5 + 2 AS c, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS vd FROM orders) o",
    ),
    "slip_reference": (
        "orders",
        "o_orderkey AS k, slip_ref(IF(o_orderkey % 3 = 0, concat('B', CAST(o_orderkey AS STRING)), ''), IF(o_orderkey % 3 = 1, '00000012', NULL), 'Ward', 2) AS ref, election_of(IF(o_orderkey % 2 = 0, 'Provincial', 'Ward')) AS election, length(unread_ref(CAST(o_orderkey AS STRING))) AS unread FROM {t}",
        "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN concat('B', CAST(o_orderkey AS STRING)) WHEN 1 THEN '00000012_WAR_p2' ELSE 'UNREAD_WAR_p2' END AS ref, CASE WHEN o_orderkey % 2 = 0 THEN '2024 PROVINCIAL ELECTION' ELSE '2024 NATIONAL ELECTION' END AS election, 15 AS unread FROM orders",
    ),
    "page_flags": (
        "lineitem",
        "k, array_join(page_flags(rows, CAST(size(rows) + 5 AS INT), 100, CAST(k % 150 AS INT)), ',') AS flags FROM (SELECT l_orderkey AS k, collect_list(named_struct('votes', CAST(IF(l_linenumber = 1, 0, l_quantity) AS INT), 'conf', 1 - 8 * l_discount, 'signed', l_linestatus = 'F', 'overflow', l_tax = 0.08D, 'disagree', l_returnflag = 'R')) AS rows FROM {t} GROUP BY l_orderkey)",
        """SELECT l_orderkey AS k, concat_ws(',', CASE WHEN bool_or(l_tax = 0.08) THEN 'votes_exceed_registered' END, CASE WHEN bool_or(l_returnflag = 'R') THEN 'ocr_engine_disagreement' END, CASE WHEN bool_or(l_linenumber <> 1 AND l_quantity >= 1 AND 1 - 8 * l_discount < 0.72) THEN 'low_confidence_digits' END, CASE WHEN bool_or(1 - 8 * l_discount < 0.4) THEN 'unreadable_digits' END,
        CASE WHEN bool_or((l_linenumber = 1 OR l_quantity < 1) AND l_linestatus = 'F') THEN 'signature_on_zero_vote_row' END, CASE WHEN count(*) >= 3 AND sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END) = 0 THEN 'no_votes_read' END, CASE WHEN sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END) > 100 THEN 'party_sum_exceeds_registered' END, CASE WHEN l_orderkey % 150 > 100 THEN 'cast_exceeds_registered' END) AS flags FROM lineitem GROUP BY l_orderkey""",
    ),
    "reconcile_totals": (
        "lineitem",
        "l_orderkey, l_linenumber, l_partkey, x.valid, x.spoilt, x.cast AS cast_votes FROM (SELECT l_orderkey, l_linenumber, l_partkey, reconciled(IF(l_partkey % 4 = 0, NULL, CAST(l_partkey AS INT)), IF(l_suppkey % 3 = 0, NULL, CAST(l_quantity AS INT)), IF(l_linenumber = 5, NULL, CAST(l_partkey + l_suppkey * 3 AS INT))) AS x FROM {t})",
        """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_partkey AS INT) END AS v, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(l_quantity AS INT) END AS s, CASE WHEN l_linenumber <> 5 THEN CAST(l_partkey + l_suppkey * 3 AS INT) END AS c FROM lineitem),
        b AS (SELECT *, CASE WHEN c - v BETWEEN 0 AND 200 AND s IS NULL THEN c - v WHEN c - v BETWEEN 0 AND 200 AND s <> c - v AND contains(CAST(c - v AS STRING), CAST(s AS STRING)) AND length(CAST(s AS STRING)) < length(CAST(c - v AS STRING)) THEN c - v ELSE s END AS s1 FROM a),
        d AS (SELECT *, CASE WHEN s1 >= 10 AND c > s1 AND c - s1 <= 9999 AND (v IS NULL OR (v + s1 <> c AND (v < 200 OR v > c OR length(CAST(v AS STRING)) > length(CAST(c - s1 AS STRING))))) THEN c - s1 ELSE v END AS v1 FROM b)
        SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v1 IS NULL AND c >= s1 AND c - s1 <= 9999 THEN c - s1 ELSE v1 END AS valid, s1 AS spoilt, CASE WHEN v1 IS NULL OR s1 IS NULL OR (s1 < 10 AND v1 >= 100) OR v1 + s1 > 9999 THEN c WHEN coalesce(c, 0) = 0 OR abs(c - v1 - s1) <= 5 OR c >= 2000 THEN v1 + s1 ELSE c END AS cast_votes FROM d""",
    ),
    "cell_votes": (
        "lineitem",
        f"l_orderkey, l_linenumber, l_partkey, x.votes, round(x.conf, 6) AS conf FROM (SELECT l_orderkey, l_linenumber, l_partkey, cell_votes(array({_item('CAST(l_suppkey % 10 AS STRING)', '30', '50')}, {_item('CAST(l_partkey % 10 AS STRING)', '20', '52', '0.5D')}, {_item("IF(l_linenumber = 2, 'x', '7')", '400', '50')}), 40D, IF(l_linenumber = 3, 41D, 60D), 0D, 100D) AS x FROM {{t}})",
        "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_linenumber = 3 THEN 0 ELSE l_partkey % 10 * 10 + l_suppkey % 10 END AS INTEGER) AS votes, CASE WHEN l_linenumber = 3 THEN 0.58::DOUBLE ELSE 0.65::DOUBLE END AS conf FROM lineitem",
    ),
    "token_totals": (
        "orders",
        f"k, x.valid, x.spoilt, x.cast AS cast_votes FROM (SELECT o_orderkey AS k, token_totals(array({_item("'total valid votes'", '50', '100')}, {_item("'12'", '300', '102')}, {_item(f'CAST({_N} AS STRING)', 'IF(o_orderkey % 2 = 0, 700, 400)', '103')}, {_item("'TOTAL SPOILT VOTES'", '50', '200')}, {_item("'bb'", '300', '200')}, {_item("'5'", '500', '200')}, {_item("'TOTAL VOTES CAST'", '50', '300')}), 1000D) AS x FROM {{t}})",
        f"SELECT o_orderkey AS k, {_N} AS valid, 99 AS spoilt, CAST(NULL AS INTEGER) AS cast_votes FROM orders",
    ),
    "number_on_row": (
        "lineitem",
        f"l_orderkey, l_linenumber, l_partkey, x.votes, x.conf FROM (SELECT l_orderkey, l_linenumber, l_partkey, number_on_row(array({_item('CAST(l_suppkey % 10 AS STRING)', '30', '50', '0.97D')}, {_item("IF(l_linenumber = 1, '44', CAST(l_partkey % 10 AS STRING))", '20', '51', '0.2D')}, {_item("'9'", '25', '80')}), 40D, 60D, 0D, 100D, CAST(NULL AS DOUBLE)) AS x FROM {{t}})",
        "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_linenumber = 1 THEN l_suppkey % 10 ELSE l_partkey % 10 * 10 + l_suppkey % 10 END AS INTEGER) AS votes, 0.92::DOUBLE AS conf FROM lineitem",
    ),
    "vote_column": (
        "orders",
        f"o_orderkey AS k, x.x1, x.x2, r FROM (SELECT o_orderkey, vote_column(array({_item("IF(o_orderkey % 3 = 0, 'Votes', 'x')", 'o_custkey % 500 + 50', '20')}), 1000, IF(o_orderkey % 2 = 0, 'Ward', 'PR')) AS x, name_right(array({_item("IF(o_orderkey % 5 = 0, 'TRAAN', 'x')", '200', '20')}), 1000, IF(o_orderkey % 2 = 0, 'Ward', 'PR')) AS r FROM {{t}})",
        "SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 3 = 0 THEN greatest(0, o_custkey % 500 + 40 - 18) WHEN o_orderkey % 2 = 0 THEN 500 ELSE 420 END AS INTEGER) AS x1, CAST(CASE WHEN o_orderkey % 3 = 0 THEN floor(o_custkey % 500 + 60 + 28.8) WHEN o_orderkey % 2 = 0 THEN 720 ELSE 620 END AS INTEGER) AS x2, CASE WHEN o_orderkey % 2 = 1 THEN 420 WHEN o_orderkey % 5 = 0 THEN 230 ELSE 500 END AS r FROM orders",
    ),
    "snap_code": (
        "part",
        "p_partkey, snap_code(concat('TR', element_at(array('AB', 'AGJ', 'AFX', 'QQ', 'ZZZZZ', 'C', 'AAN '), CAST(p_partkey % 7 + 1 AS INT))), array('TRAAN', 'TRAGJ', 'TRABZ', 'TRAAF', 'TRAFI', 'TRAHB', 'TRAAE', 'TRAAB', 'TRACD'), IF(p_partkey % 2 = 0, array('TRAAB'), array())) AS code FROM {t}",
        "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'TRABZ' ELSE 'TRAAB' END WHEN 1 THEN 'TRAGJ' WHEN 2 THEN 'TRAFI' WHEN 3 THEN 'TRQQ' WHEN 6 THEN 'TRAAN' END AS code FROM part",
    ),
    "party_rows": (
        "orders",
        f"o_orderkey AS k, array_join(transform(x, r -> concat(r.party_code, '@', CAST(CAST(r.cy AS INT) AS STRING))), ',') AS rows FROM (SELECT o_orderkey, party_rows(array({_item("'TEST PARTY BB'", '50', '400 + o_orderkey % 20')}, {_item("'IEC TEST PARTY AA'", '50', '300')}, {_item("'IECTEST PARTY AA'", '60', '300 + o_orderkey % 20')}, {_item("'TOTAL VALID VOTES TEST PARTY CC'", '60', '500')}, {_item("'TEST PARTY DD'", '60', '990')}), 'PR', 1000D) AS x FROM {{t}})",
        "SELECT o_orderkey AS k, concat('AA@300,', CASE WHEN o_orderkey % 20 >= 12 THEN concat('AA@', CAST(300 + o_orderkey % 20 AS STRING), ',') ELSE '' END, 'BB@', CAST(400 + o_orderkey % 20 AS STRING)) AS rows FROM orders",
    ),
    "row_bands": (
        "orders",
        "o_orderkey AS k, b[0].y1 AS a, b[0].y2 AS b, b[1].y1 AS c, b[1].y2 AS d FROM (SELECT o_orderkey, row_bands(array(CAST(100 + o_orderkey % 10 AS DOUBLE), CAST(200 + o_custkey % 10 AS DOUBLE)), array(10D, 10D), 230) AS b FROM {t})",
        "SELECT o_orderkey AS k, CAST(trunc(100 + o_orderkey % 10 - (100 + o_custkey % 10 - o_orderkey % 10) / 2.0::DOUBLE) AS INTEGER) AS a, CAST(trunc((300 + o_orderkey % 10 + o_custkey % 10) / 2.0::DOUBLE) AS INTEGER) AS b, CAST(trunc((300 + o_orderkey % 10 + o_custkey % 10) / 2.0::DOUBLE) AS INTEGER) AS c, 230 AS d FROM orders",
    ),
    "row_alignment": (
        "orders",
        "o_orderkey AS k, array_join(transform(x, r -> concat(CAST(r.y1 AS STRING), '-', CAST(r.y2 AS STRING))), ',') AS rows FROM (SELECT o_orderkey, aligned_rows(filter(concat(transform(sequence(0, 5), j -> CAST(100 + 20 * j AS INT)), array(IF(o_orderkey % 2 = 0, 103, 100))), y -> o_orderkey % 2 = 0 OR y <> 100 + 20 * (o_orderkey % 4 + 1)), 5) AS x FROM {t})",
        "SELECT o_orderkey AS k, concat(CASE WHEN o_orderkey % 2 = 0 THEN '103' ELSE '100' END, '-120,120-140,140-160,160-180,180-200') AS rows FROM orders",
    ),
    "band_names": (
        "orders",
        f"o_orderkey AS k, band_name(array({_item("'Roe '", '300', '52')}, {_item("concat('Jane', CAST(o_custkey % 5 AS STRING))", '300', '48')}, {_item("'12'", '300', '50')}, {_item("'margin'", '15', '50')}, {_item("'TRAAN'", '300', '50')}), 40D, 60D, 500D, 1000D) AS name FROM {{t}}",
        "SELECT o_orderkey AS k, concat('Jane', CAST(o_custkey % 5 AS STRING), ' Roe') AS name FROM orders",
    ),
    "result_header": (
        "orders",
        f"o_orderkey AS k, header_bottom(array({_item("'Result:'", '50', 'o_custkey % 500')}, {_item("'RESULTS'", '50', '300')}), 1000D) AS bottom, edge_at(10D, 0.5D, 100D, CAST(o_custkey AS DOUBLE)) AS edge FROM {{t}}",
        "SELECT o_orderkey AS k, CASE WHEN o_custkey % 500 BETWEEN 160 AND 380 THEN CAST(o_custkey % 500 + 6 AS DOUBLE) END AS bottom, 10 + 0.5::DOUBLE * (o_custkey - 100) AS edge FROM orders",
    ),
    "layout_score": (
        "orders",
        "o_orderkey AS k, layout_score(array(named_struct('name', 'Alpha Party of Hope', 'code', 'A.P'), named_struct('name', 'Beta', 'code', concat('B', CAST(o_orderkey % 3 AS STRING)))), norm_key('the alpha party of a.p. b1')) AS score, best_layout(array(array(named_struct('name', 'n', 'code', 'zz')), array(named_struct('name', 'n', 'code', concat('q', CAST(o_orderkey % 2 AS STRING)))), array(named_struct('name', 'n', 'code', 'q0'))), 'Q0') AS best FROM {t}",
        "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 1 THEN 5 ELSE 3 END AS score, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS best FROM orders",
    ),
    "display_values": (
        "orders",
        "o_orderkey AS k, status_label(element_at(array('approved', 'pending_review', 'on_hold'), CAST(o_orderkey % 3 + 1 AS INT))) AS label, ballot_class(concat(' ', o_orderpriority, '! ')) AS class, duration_text(CAST(o_custkey AS DOUBLE)) AS took, iso_utc(o_orderdate) AS day, shown(IF(o_orderkey % 2 = 0, '', 'x')) AS shown, digit_token(concat('B', CAST(o_custkey AS STRING), 'l')) AS token, as_json_text(IF(o_orderkey % 2 = 0, array(), array('a'))) AS flags FROM {t}",
        """SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Approved' WHEN 1 THEN 'Ready' ELSE 'on hold' END AS label, lower(replace(o_orderpriority, ' ', '-')) AS class, concat(CAST(o_custkey // 60 AS STRING), ':', lpad(CAST(o_custkey % 60 AS STRING), 2, '0')) AS took, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS day, CASE WHEN o_orderkey % 2 = 0 THEN '—' ELSE 'x' END AS shown, concat('8', CAST(o_custkey AS STRING), '1') AS token, CASE WHEN o_orderkey % 2 = 1 THEN '["a"]' END AS flags FROM orders""",
    ),
    "relative_time": (
        "orders",
        "o_orderkey AS k, x.n, x.unit FROM (SELECT o_orderkey, relative_time(-o_custkey * o_custkey * 17) AS x FROM {t})",
        "WITH a AS (SELECT o_orderkey AS k, -o_custkey * o_custkey * 17 AS s FROM orders), b AS (SELECT *, floor(s / 60.0::DOUBLE + 0.5) AS m FROM a), c AS (SELECT *, floor(m / 60 + 0.5) AS h FROM b), d AS (SELECT *, floor(h / 24 + 0.5) AS dd FROM c), e AS (SELECT *, floor(dd / 30 + 0.5) AS mo FROM d) SELECT k, CAST(CASE WHEN -s < 60 THEN s WHEN -m < 60 THEN m WHEN -h < 24 THEN h WHEN -dd < 30 THEN dd WHEN -mo < 12 THEN mo ELSE floor(mo / 12 + 0.5) END AS BIGINT) AS n, CASE WHEN -s < 60 THEN 'second' WHEN -m < 60 THEN 'minute' WHEN -h < 24 THEN 'hour' WHEN -dd < 30 THEN 'day' WHEN -mo < 12 THEN 'month' ELSE 'year' END AS unit FROM e",
    ),
}


def _run(table: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        forms.register(spark)
        for t in ("orders", "lineitem", "part"):
            if t in table:
                spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql("SELECT " + text.replace("{t}", table))

    return run


def _box_items(spark: SparkSession, d: str) -> DataFrame:
    forms.register(spark)
    e = spark.read.parquet(f"{d}/events.parquet")
    x, y = F.col("value"), F.col("event_id").cast("double")
    e = e.withColumn("p", F.when(F.col("event_id") % 9 != 0, F.array(F.array(x, y), F.array(x + 4, y), F.array(x + 4, y + 2), F.array(x, y + 2))))
    return e.selectExpr("event_id", "box_item(event_type, CAST(NULL AS DOUBLE), p) AS b").select("event_id", "b.text", "b.score", *[F.round(f"b.{c}", 6).alias(c) for c in ("cx", "cy", "x1", "x2", "y1", "y2")])


_BOX = "SELECT event_id, event_type AS text, 0.0::DOUBLE AS score, " + ", ".join(f"CASE WHEN event_id % 9 = 0 THEN 0.0::DOUBLE ELSE round({v}, 6) END AS {c}" for c, v in (("cx", "value + 2"), ("cy", "event_id + 1.0::DOUBLE"), ("x1", "value"), ("x2", "value + 4"), ("y1", "event_id + 0.0::DOUBLE"), ("y2", "event_id + 2.0::DOUBLE"))) + " FROM events"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _run(t, q) for k, (t, q, _) in QUERIES.items()} | {"box_items": _box_items}


def oracle_sql() -> dict[str, str]:
    return {k: o for k, (_, _, o) in QUERIES.items()} | {"box_items": _BOX}
