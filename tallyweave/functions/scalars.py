"""Scalar functions over form text and digits, as SQL functions that Catalyst inlines (no Python in the plan).

register(spark) makes them callable from SQL and expr(). NULL in gives the stated "missing" result, never an error.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# A registered function can't be called within a lambda: the forms below give the text of a call, for either place.


def let(name: str, value: str, body: str) -> str:
    """body with the value bound to a name once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def norm_key(t: str) -> str:
    return f"regexp_replace(upper(coalesce({t}, '')), '[^A-Z0-9#]', '')"


def vote_digits(t: str) -> str:
    """Look-alike letters to digits, the last four digits; nothing left: NULL."""
    return f"try_cast(nullif(right(regexp_replace(translate(upper(coalesce({t}, '')), 'ØÓODΦφIL', '00000011'), '[^0-9]', ''), 4), '') AS INT)"


def page_marker(t: str) -> str:
    n = lambda g: rf"try_cast(nullif(regexp_extract(regexp_replace(coalesce({t}, ''), '\\s+', ''), '(?i)page([0-9]+)of([0-9]+)', {g}), '') AS INT)"
    return f"named_struct('n', {n(1)}, 'total', {n(2)})"


def barcode_repair(t: str, vd: str) -> str:
    """Misread beginnings of 18 digits."""
    fixed = f"concat(IF(left(__d, 5) IN ('80133', '08133', '88133', '90133'), '00', left(__d, 2)), substring(__d, 3, 4), IF(length({vd}) = 8, {vd}, substring(__d, 7, 8)), right(__d, 4))"
    return let("__d", f"regexp_replace(coalesce({t}, ''), '[^0-9]', '')", f"IF(length(__d) = 18, {fixed}, __d)")


def barcode_hit(d: str, family: str) -> str:
    return f"regexp_extract({d}, CASE WHEN {family} = 'lg2026' THEN '[0-9]{{14}}[346][0-9]{{3}}' ELSE '[0-9]{{14}}[123][0-9]{{3}}' END, 0)"


def title_type(t: str) -> str:
    """Printed titles of ballot types."""
    return rf"""CASE WHEN upper({t}) RLIKE 'DISTRICT COUNCIL PR|YELLOW BALLOT|DC40 BALLOT' THEN 'District Council PR' WHEN upper({t}) RLIKE 'WARD CANDIDATE|WHITE BALLOT|\\bWARD BALLOT\\b' THEN 'Ward'
        WHEN upper({t}) RLIKE 'LOCAL COUNCIL PR|GREEN BALLOT|\\bPR BALLOT\\b' THEN 'Local Council PR' END"""


def tail_votes(d: str) -> str:
    """The last matching rule of an over-long reading: four digits, else three, else four as they are."""
    whole = "CASE WHEN length(__t) <= 4 THEN try_cast(nullif(__t, '') AS INT) WHEN try_cast(right(__t, 4) AS INT) >= 100 THEN try_cast(right(__t, 4) AS INT) WHEN try_cast(right(__t, 3) AS INT) >= 10 THEN try_cast(right(__t, 3) AS INT) ELSE try_cast(right(__t, 4) AS INT) END"
    return let("__t", d, whole)


def open_digits(m: str) -> str:
    """Letters that are all of one look-alike digit."""
    plain = "regexp_replace(__m, '[^A-Za-z0-9]', '')"
    return let("__m", m, f"CASE WHEN {plain} RLIKE '^[bB]+$' THEN translate(__m, 'bB', '99') WHEN {plain} RLIKE '^[0-9][bB]$' THEN concat('9', left({plain}, 1)) WHEN {plain} RLIKE '^[CcZz2]+$' THEN translate({plain}, 'CcZz', '2222') ELSE __m END")


def open_votes(t: str) -> str:
    digits = "regexp_replace(translate(" + open_digits("translate(trim(__o), '于了', '77')") + ", 'ØøOoIl', '000011'), '[^0-9]', '')"
    return let("__o", f"coalesce({t}, '')", f"CASE WHEN trim(__o) <> '' THEN coalesce({tail_votes(digits)}, {vote_digits('__o')}) END")


#: Codes of ballot types in local elections.
LOCAL_TYPE = "CASE {0} WHEN '3' THEN 'Local Council PR' WHEN '4' THEN 'Ward' WHEN '6' THEN 'District Council PR' END"

#: (signature, return type, body), in an order in which each uses earlier ones only.
FUNCTIONS: list[tuple[str, str, str]] = [
    ("norm_key(t STRING)", "STRING", norm_key("t")),
    ("vote_digits(t STRING)", "INT", vote_digits("t")),
    ("family_base(r STRING)", "STRING", r"regexp_replace(coalesce(r, ''), '^(.*) \\([0-9]+\\)$', '$1')"),
    ("copy_number(r STRING)", "INT", r"coalesce(try_cast(nullif(regexp_extract(coalesce(r, ''), ' \\(([0-9]+)\\)$', 1), '') AS INT), 1)"),
    ("next_copy(used ARRAY<INT>)", "INT", "array_min(array_except(sequence(2, size(used) + 2), used))"),
    ("flag_list(j STRING)", "ARRAY<STRING>", "coalesce(from_json(j, 'array<string>'), array())"),
    ("page_marker(t STRING)", "STRUCT<n: INT, total: INT>", page_marker("t")),
    ("barcode_repair(t STRING, vd STRING)", "STRING", barcode_repair("t", "vd")),
    ("barcode_hit(d STRING, family STRING)", "STRING", barcode_hit("d", "family")),
    # The codes of ballot types differ between families of forms; local elections have two pages each.
    (
        "barcode_parts(hit STRING, family STRING DEFAULT NULL)",
        "STRUCT<raw_barcode: STRING, slip_reference: STRING, prefix: STRING, voting_district: STRING, ballot_type: STRING, ballot_type_code: STRING, page_number: INT, page_total: INT>",
        f"""CASE WHEN hit <> '' THEN named_struct('raw_barcode', hit, 'slip_reference', left(hit, 15), 'prefix', left(hit, 6), 'voting_district', substring(hit, 7, 8), 'ballot_type',
        CASE WHEN family = 'lg2026' THEN {LOCAL_TYPE.format("substring(hit, 15, 1)")} ELSE element_at(map('1', 'National', '2', 'Provincial', '3', 'Regional'), substring(hit, 15, 1)) END,
        'ballot_type_code', substring(hit, 15, 1), 'page_number', CAST(substring(hit, 16, 2) AS INT), 'page_total', IF(substring(hit, 15, 1) = '1' AND NOT family <=> 'lg2026', 3, 2)) END""",
    ),
    ("local_type(code STRING)", "STRING", LOCAL_TYPE.format("code")),
    ("title_type(t STRING)", "STRING", title_type("t")),
    ("tail_votes(d STRING)", "INT", tail_votes("d")),
    ("open_digits(m STRING)", "STRING", open_digits("m")),
    ("open_votes(t STRING)", "INT", open_votes("t")),
    (
        "fit_votes(v INT, n INT)",
        "INT",
        "CASE WHEN n <= 0 OR v < 0 OR length(string(v)) <= n THEN v WHEN length(string(v)) = n + 1 AND v % 10 = 0 THEN IF(n = 1, 0, v DIV 10) ELSE CAST(right(string(v), n) AS INT) END",
    ),
    (
        "choose_votes(item INT, crop INT, n INT)",
        "INT",
        """CASE WHEN coalesce(item, 0) = 0 THEN IF(crop <= 999, crop, 0) WHEN coalesce(crop, 0) = 0 OR crop > 999 THEN item WHEN item < 10 AND crop BETWEEN 10 AND 99 AND n >= 2 THEN crop
        WHEN length(string(crop)) = length(string(item)) + 1 AND endswith(string(crop), string(item)) AND NOT (item >= 10 AND crop % 10 = 0) THEN crop ELSE item END""",
    ),
    ("dash_noise(v INT)", "BOOLEAN", r"v > 1 AND (string(v) RLIKE '^1{2,4}$' OR (v >= 100 AND length(replace(string(v), '1', '')) <= 1) OR string(v) RLIKE '^(?=.{4}$)(?=(.*1){2})(?=(.*0){2})' OR string(v) RLIKE '^[12]{4}$' OR string(v) RLIKE '^[0389]{3,}$')"),
    (
        "extra_digit(r INT, i INT)",
        "BOOLEAN",
        """r > 0 AND i > 0 AND length(string(r)) = length(string(i)) + 1 AND exists(sequence(1, length(string(r))), p -> concat(left(string(r), p - 1), substring(string(r), p + 1)) = string(i)
        AND ((substring(string(r), p, 1) IN ('1', '8') AND NOT (p = length(string(r)) AND startswith(string(r), string(i)))) OR (substring(string(r), p, 1) IN ('3', '7', '9') AND p = 1)
        OR (substring(string(r), p, 1) NOT IN ('1', '8') AND contains(string(i), substring(string(r), p, 1)))))""",
    ),
    (
        "peel_rule(v INT)",
        "INT",
        r"""CASE WHEN v < 1000 THEN NULL WHEN string(v) RLIKE '^21[089]' THEN CAST(concat(left(string(v), 1), right(string(v), 1)) AS INT)
        WHEN regexp_replace(regexp_replace(string(v), '^[12]+(?=..)', ''), '^0+(?=.)', '') RLIKE '^([0-7][0-9]|[0-9])$' AND string(v) RLIKE '^[12]'
        THEN CAST(regexp_replace(regexp_replace(string(v), '^[12]+(?=..)', ''), '^0+(?=.)', '') AS INT) END""",
    ),
    (
        "dash_inflated(r INT, i INT)",
        "BOOLEAN",
        r"""r > 0 AND i > 0 AND length(string(r)) > length(string(i)) AND ((replace(string(r), '1', '') = string(i) AND (length(replace(string(r), '1', '')) <= length(string(r)) - 2 - regexp_count(string(i), '1') OR startswith(string(r), '1') AND NOT startswith(string(i), '1')))
        OR (endswith(string(r), string(i)) AND left(string(r), length(string(r)) - length(string(i))) RLIKE '^1+$'))""",
    ),
    # Four boxes: a gap inside, a lone 5-9 in the first box, and sevens inside only are noise.
    (
        "box_votes(d ARRAY<INT>)",
        "STRUCT<votes: INT, conf: DOUBLE>",
        r"""(SELECT CASE WHEN s RLIKE '^_*$' THEN named_struct('votes', 0, 'conf', 0.90D) WHEN s RLIKE '[0-9]_+[0-9]' THEN named_struct('votes', 0, 'conf', 0.40D)
        WHEN s RLIKE '^[5-9]_+$' OR s RLIKE '^_+7{2,}_*$' THEN named_struct('votes', 0, 'conf', 0.55D) WHEN CAST(replace(s, '_', '') AS INT) = 0 THEN named_struct('votes', 0, 'conf', 0.88D)
        ELSE named_struct('votes', CAST(replace(s, '_', '') AS INT), 'conf', 0.80D) END FROM (SELECT rpad(array_join(slice(d, 1, 4), '', '_'), 4, '_') AS s))""",
    ),
    ("cell_labels(d ARRAY<INT>)", "ARRAY<INT>", "IF(size(d) = 4 AND forall(d, x -> x IS NULL OR x BETWEEN 0 AND 9), d, NULL)"),
    ("remaining_s(elapsed DOUBLE, done DOUBLE, total DOUBLE, frac DOUBLE)", "DOUBLE", "greatest(0D, CASE WHEN done + frac < 0.05D THEN 18D * total - elapsed ELSE elapsed / (done + frac) * (total - done - frac) END)"),
    ("percent_done(done DOUBLE, total DOUBLE, frac DOUBLE)", "INT", "CAST(least(100D, greatest(0D, bround(100D * (done + frac) / greatest(1D, total)))) AS INT)"),
]


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, once."""
    declare(spark, "scalars", FUNCTIONS)


def declare(spark: SparkSession, what: str, functions: list[tuple[str, str, str]]) -> None:
    known = spark.__dict__.setdefault("_tallyweave_functions", set())
    if what in known:
        return
    known.add(what)
    for signature, kind, body in functions:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
