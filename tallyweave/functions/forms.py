"""From lines and placed tokens of a page to a record's parts, as SQL functions that Catalyst inlines.

Lines are ARRAY<STRING>; a token is ITEM, a text with its score, centre and extent. register(spark) makes the functions
callable from SQL and expr().
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyweave.functions import scalars as s
from tallyweave.functions.scalars import let as _let

ITEM = "STRUCT<text: STRING, score: DOUBLE, cx: DOUBLE, cy: DOUBLE, x1: DOUBLE, x2: DOUBLE, y1: DOUBLE, y2: DOUBLE>"
LAYOUT = "ARRAY<STRUCT<name: STRING, code: STRING>>"
PARTY = "STRUCT<party_name: STRING, party_code: STRING, cy: DOUBLE, y1: DOUBLE, y2: DOUBLE, label: " + ITEM + ">"

#: Printed phrases of which two make a page a result page.
HINTS = (
    "RESULT SLIP", "RESULTS", "VOTES CAST", "VALID VOTES", "SPOILT", "REGISTERED VOTER", "VOTING DISTRICT", "PRESIDING OFFICER", "NATIONAL BALLOT", "PROVINCIAL BALLOT",
    "REGIONAL BALLOT", "ELECTORAL COMMISSION", "DISTRICT COUNCIL PR", "WARD CANDIDATE", "LOCAL COUNCIL PR", "YELLOW BALLOT", "GREEN BALLOT", "WHITE BALLOT", "IEC TEST PARTY",
)
#: Provinces.
PROVINCES = ("Eastern Cape", "Free State", "Gauteng", "KwaZulu-Natal", "Limpopo", "Mpumalanga", "Northern Cape", "North West", "Western Cape")
#: Printed codes of ward candidates.
WARD_CODES = ("TRAAN", "TRAGJ", "TRABZ", "TRAAF", "TRAFI", "TRAHB", "TRAAE", "TRAAB", "TRACD")
#: Lines of a table that are not rows of parties.
_NO_ROW = r"(?i)TOTAL\\s+(VALID|SPOILT|VOTES|SPECIAL|SECTION|DC|WARD|PR)\\b|COUNTING\\s+OFFICER|ADDRESSES\\s+DISPUTED|SIGNATURE|PARTY\\s+NAME|CANDIDATE\\s+NAME|YELLOW\\s+BALLOT|GREEN\\s+BALLOT|WHITE\\s+BALLOT"
_NO_STATION = "(?i)PAGE|RESULT|SIGNATURE|PARTY|REGISTERED|PRESIDING|BALLOT|ELECTION|NATIONAL|PROVINCIAL|REGIONAL"
_WARD = r"(?i)\\b(TR[A-Z]{2,4})\\b"
_TEST_PARTY = r"(?i)(?:I?EC\\s*)?TEST\\s*PARTY\\s*([A-Z]{2,4})"


def _texts(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _first(array: str) -> str:
    return f"get({array}, 0)"


def _near(line: str, before: int, after: int) -> str:
    """The lines around each line that matches, joined."""
    at = "filter(sequence(1, greatest(size(lines), 1)), i -> coalesce(get(lines, i - 1), '') RLIKE '" + line + "')"
    return f"transform({at}, i -> array_join(slice(lines, greatest(i - {before}, 1), i + {after} - greatest(i - {before}, 1) + 1), ' '))"


_NUMBERS = r"flatten(transform(" + _near(r"(?i)Registered\\s*Voters", 1, 3) + r", t -> filter(transform(regexp_extract_all(t, '\\b([0-9]{2,5})\\b', 1), v -> CAST(v AS INT)), v -> v BETWEEN 20 AND 20000)))"
_NAMES = r"filter(transform(" + _near(r"(?i)PRESIDING\\s*OFFICER\\s*NAME", 0, 2) + r", t -> regexp_extract(t, '(?i)NAME\\s*[:|]?\\s*([A-Z][A-Za-z\\s]{4,40})', 1)), n -> n <> '')"


def _row_hits(label: str) -> str:
    """(cx, votes) of the numbers right of a label, on its row."""
    near = f"filter(items, i -> i.cx >= {label}.x2 + 2 AND abs(i.cy - {label}.cy) <= greatest(12D, ({label}.y2 - {label}.y1) * 0.7D))"
    return f"array_sort(filter(transform({near}, i -> named_struct('cx', i.cx, 'votes', {s.open_votes('i.text')})), h -> h.votes IS NOT NULL))"


def _after(label: str) -> str:
    found = rf"regexp_extract(t, concat('(?iu)', {label}, '[:\\s]*([0-9OØ\\s]{{1,12}})'), 1)"
    return s.vote_digits(found)


def _score(layout: str, blob: str) -> str:
    code, name = s.norm_key("x.code"), s.norm_key("x.name")
    return f"2 * size(filter({layout}, x -> {code} <> '' AND contains({blob}, {code}))) + size(filter(slice({layout}, 1, 8), x -> {name} <> '' AND contains({blob}, left({name}, 12))))"


def _mended_spoilt(v: str, x: str, c: str) -> str:
    left_out = f"({x} IS NULL OR {x} <> {c} - {v} AND contains(string({c} - {v}), string({x})) AND length(string({x})) < length(string({c} - {v})))"
    return f"CASE WHEN {c} - {v} BETWEEN 0 AND 200 AND {left_out} THEN {c} - {v} ELSE {x} END"


def _mended_valid(v: str, x: str, c: str) -> str:
    odd = f"({v} IS NULL OR {v} + {x} <> {c} AND ({v} < 200 OR {v} > {c} OR length(string({v})) > length(string({c} - {x}))))"
    return f"CASE WHEN {x} >= 10 AND {c} > {x} AND {c} - {x} <= 9999 AND {odd} THEN {c} - {x} ELSE {v} END"


def _mended_cast(v: str, x: str, c: str) -> str:
    return f"CASE WHEN {x} < 10 AND {v} >= 100 THEN {c} WHEN {v} + {x} BETWEEN 0 AND 9999 AND (coalesce({c}, 0) = 0 OR abs({c} - {v} - {x}) <= 5 OR {c} >= 2000) THEN {v} + {x} ELSE {c} END"


def _snap(token: str, codes: str, used: str) -> str:
    pick = "CASE WHEN length(__r) < 3 THEN NULL WHEN array_contains({codes}, __r) THEN __r WHEN __r = 'TRAB' AND array_contains(__free, 'TRAAB') THEN 'TRAAB' WHEN size(filter(__free, c -> startswith(c, __r))) = 1 THEN filter(__free, c -> startswith(c, __r))[0] WHEN size(filter(__free, c -> levenshtein(__r, c) = 1)) = 1 THEN filter(__free, c -> levenshtein(__r, c) = 1)[0] WHEN __r LIKE 'TR%' AND length(__r) BETWEEN 4 AND 5 AND NOT array_contains(coalesce({used}, array()), __r) THEN __r END"
    return _let("__r", f"regexp_replace(upper(coalesce({token}, '')), '[^A-Z]', '')", _let("__free", f"array_except({codes}, coalesce({used}, array()))", pick.format(codes=codes, used=used)))


def _place(pattern: str, stop: str) -> str:
    """'code - place' after a municipality's code; the place ends before a label."""
    place = rf"btrim(split(btrim(regexp_replace(regexp_extract(t, '{pattern}', 2), '\\s+', ' '), ' -'), '(?i){stop}')[0], ' -')"
    code = rf"regexp_extract(t, '{pattern}', 1)"
    return f"CASE WHEN {code} <> '' THEN {code} || IF({place} <> '', ' - ' || {place}, '') END"


def _total(pattern: str, large: bool) -> str:
    """A total from the tokens right of its label: large totals may have run over the box, others stand in it."""
    label = f"get(array_sort(transform(filter(items, i -> i.text RLIKE '(?i){pattern}'), i -> named_struct('x', i.x1, 'item', i))), 0).item"
    over, boxed = "transform(filter(h, v -> v.cx >= width * 0.66D), v -> v.votes)", "transform(filter(h, v -> v.cx < width * 0.66D), v -> v.votes)"
    last = lambda a: f"try_element_at({a}, -1)"
    if large:
        pick = f"CASE WHEN {last(over)} >= 30 THEN {last(over)} ELSE coalesce({last(f'filter({boxed}, v -> v >= 30)')}, {last(boxed)}) END"
    else:
        pick = f"coalesce(get({boxed}, 0), get(h, 0).votes)"
    return _let("l", label, f"IF(l IS NULL, NULL, {_let('h', _row_hits('l'), pick)})")


def _median(a: str) -> str:
    return _let("__s", f"array_sort({a})", "(__s[(size(__s) - 1) DIV 2] + __s[size(__s) DIV 2]) / 2D")


def _gaps(a: str) -> str:
    return f"transform(sequence(1, size({a}) - 1), j -> CAST({a}[j] - {a}[j - 1] AS DOUBLE))"


def _aligned() -> str:
    """Rows between ruled lines: the most regular run of n + 1 lines; else all lines with missed ones put in, those too near
    left out, and what is missing at the end carried on by the median of the last gaps."""
    mean = "aggregate(g, 0D, (a, x) -> a + x) / size(g)"
    spread = f"sqrt(aggregate(transform(g, x -> (x - {mean}) * (x - {mean})), 0D, (a, x) -> a + x) / size(g))"
    score = _let("m", _median("g"), f"IF(array_min(g) >= greatest(6D, m * 0.55D) AND array_max(g) <= m * 1.65D, -{spread} - abs(m - {mean}), NULL)")
    band = "slice(l, i + 1, n + 1)"
    best = f"array_max(filter(transform(sequence(0, size(l) - n - 1), i -> named_struct('score', {_let('g', _gaps(band), score)}, 'first', -i)), b -> b.score IS NOT NULL))"
    whole = f"IF(size(l) > n, transform(slice(l, 1 - {best}.first, n + 1), x -> CAST(x AS DOUBLE)), NULL)"
    missed = "greatest(1, CAST(bround((y - try_element_at(b, -1)) / m) AS INT))"
    fill = f"IF({missed} > 1 AND y - try_element_at(b, -1) > m * 1.55D, transform(sequence(1, greatest({missed} - 1, 1)), k -> try_element_at(b, -1) + k * (y - try_element_at(b, -1)) / {missed}), CAST(array() AS ARRAY<DOUBLE>))"
    grown = f"aggregate(slice(l, 2, size(l)), array(CAST(l[0] AS DOUBLE)), (b, y) -> IF(size(b) > n OR y - try_element_at(b, -1) < m * 0.52D, b, concat(b, {fill}, array(CAST(y AS DOUBLE)))))"
    step = _let("r", f"filter({_gaps('__t')}, x -> x > m * 0.55D)", f"IF(size(r) > 0, {_median('r')}, m)")
    step = _let("__t", "slice(b, greatest(size(b) - 6, 1), 7)", f"IF(size(__t) > 1, {step}, m)")
    carried = _let("b", grown, _let("d", step, "concat(b, IF(size(b) <= n, transform(sequence(1, n + 1 - size(b)), k -> try_element_at(b, -1) + k * d), CAST(array() AS ARRAY<DOUBLE>)))"))
    other = _let("p", f"filter({_gaps('l')}, x -> x > 3)", _let("m", f"IF(size(p) > 0, {_median('p')}, NULL)", f"IF(m > 0, {carried}, NULL)"))
    rows = "IF(e IS NULL, CAST(array() AS ARRAY<STRUCT<y1: INT, y2: INT>>), transform(sequence(1, n), k -> named_struct('y1', CAST(bround(e[k - 1]) AS INT), 'y2', CAST(bround(e[k]) AS INT))))"
    return _let("l", "array_sort(array_distinct(lines))", f"IF(n < 1 OR size(l) < 2, CAST(array() AS ARRAY<STRUCT<y1: INT, y2: INT>>), {_let('e', f'coalesce({whole}, {other})', rows)})")


#: (signature, return type, body), in an order in which each uses earlier ones and those of scalars.py only.
FUNCTIONS: list[tuple[str, str, str]] = [
    # Lines: place, people, totals.
    (
        "find_province(t STRING, names ARRAY<STRING>)",
        "STRING",
        r"coalesce(get(filter(names, n -> contains(upper(t), upper(n)) OR contains(norm_key(t), replace(upper(n), ' ', ''))), 0), IF(t RLIKE '(?i)NORTH\\s*WEST', 'North West', NULL))",
    ),
    ("find_municipality(t STRING)", "STRING", _place(r"\\b([A-Z]{2,3}[0-9]{3})\\s*[-–]?\\s*([A-Za-z][A-Za-z\\s-]{2,40})", r"\\bVD\\b|\\bRegistered\\b|\\bPresiding\\b")),
    ("find_vd(t STRING)", "STRING", r"nullif(regexp_extract(t, '(?i)VD\\s*([0-9]{8})', 1), '')"),
    (
        "find_registered(lines ARRAY<STRING>)",
        "INT",
        rf"coalesce(try_cast(nullif(regexp_extract(array_join(lines, ' '), '(?i)Registered\\s*Voters[:\\s]*([0-9]{{2,5}})', 1), '') AS INT), {_first(_NUMBERS)}, try_cast(coalesce(nullif(regexp_extract(norm_key(array_join(lines, ' ')), 'VOTERS([0-9]{{2,5}})', 1), ''), nullif(regexp_extract(array_join(lines, ' '), '(?i)Voters[:\\s]*([0-9]{{2,5}})', 1), '')) AS INT))",
    ),
    (
        "find_station(lines ARRAY<STRING>)",
        "STRING",
        rf"""regexp_replace(upper(coalesce(
        {_first(rf"filter(transform(filter(sequence(1, greatest(size(lines), 1)), i -> coalesce(get(lines, i - 1), '') RLIKE '(?i)\\bVD\\s*[0-9]{{8}}'), i -> trim(get(lines, i))), s -> length(s) > 4 AND NOT s RLIKE '{_NO_STATION}')")},
        {_first(rf"filter(lines, s -> s RLIKE '(?i)STATION|TRADITIONAL|SHOP|SCHOOL|HALL|CHURCH' AND (NOT s RLIKE '{_NO_STATION}' OR s RLIKE '(?i)STATION|TRADITIONAL'))")})), '\\s+', ' ')""",
    ),
    ("find_officer(lines ARRAY<STRING>)", "STRING", rf"trim(split(trim(regexp_replace(upper(try_element_at({_NAMES}, -1)), '\\s+', ' ')), '\\bSIGNATURE\\b|\\bUSE\\b')[0])"),
    (
        "location_of(lines ARRAY<STRING>, names ARRAY<STRING>)",
        "STRUCT<province: STRING, municipality: STRING, voting_district: STRING, registered_voters: INT, station_name: STRING, officer: STRING>",
        r"named_struct('province', find_province(array_join(lines, ' '), names), 'municipality', find_municipality(regexp_replace(array_join(lines, ' '), '\\s+', ' ')), 'voting_district', find_vd(array_join(lines, ' ')), 'registered_voters', find_registered(lines), 'station_name', find_station(lines), 'officer', find_officer(lines))",
    ),
    ("after_label(t STRING, label STRING)", "INT", _after("label")),
    (
        "totals_of(lines ARRAY<STRING>)",
        "STRUCT<valid: INT, spoilt: INT, cast: INT, special: INT, s24a: INT>",
        _let(
            "t",
            r"regexp_replace(array_join(lines, ' '), '\\s+', ' ')",
            "named_struct('valid', "
            + _after(r"'TOTAL\\s*VALID\\s*VOTES\\s*CAST'")
            + ", 'spoilt', coalesce("
            + _after(r"'TOTAL\\s*NUMBER\\s*OF\\s*SPOILT'")
            + ", "
            + _after(r"'SPOILT\\s*RESULTS'")
            + "), 'cast', "
            + s.vote_digits(r"try_element_at(regexp_extract_all(t, '(?iu)TOTAL\\s*VOTES\\s*CAST[:\\s]*([0-9OØ\\s]{1,12})', 1), -1)")
            + ", 'special', "
            + _after(r"'SPECIAL\\s*VOTES?'")
            + ", 's24a', coalesce("
            + _after(r"'SECTION\\s*24A'")
            + ", "
            + _after("'24A'")
            + "))",
        ),
    ),
    # Valid and spoilt make the votes cast: each step sees what the one before has mended.
    (
        "reconciled(v INT, s INT, c INT)",
        "STRUCT<valid: INT, spoilt: INT, cast: INT>",
        _let("a", _mended_spoilt("v", "s", "c"), _let("b", _mended_valid("v", "a", "c"), f"named_struct('valid', CASE WHEN b IS NULL AND c >= a AND c - a <= 9999 THEN c - a ELSE b END, 'spoilt', a, 'cast', {_mended_cast('b', 'a', 'c')})")),
    ),
    # Which page, which form, which layout.
    (f"layout_score(layout {LAYOUT}, blob STRING)", "INT", _score("layout", "blob")),
    (f"best_layout(layouts ARRAY<{LAYOUT}>, blob STRING)", "INT", f"-array_max(transform(layouts, (l, i) -> named_struct('score', {_score('l', 'blob')}, 'first', -i))).first"),
    (
        "looks_like_slip(lines ARRAY<STRING>, barcode BOOLEAN, vd STRING, score INT)",
        "BOOLEAN",
        f"coalesce(barcode, false) OR upper(trim(coalesce(vd, ''))) NOT IN ('', 'UNKNOWN') OR coalesce(score, 0) >= 3 OR size(filter({_texts(HINTS)}, h -> contains(upper(array_join(lines, ' ')), h))) >= 2",
    ),
    (
        "classify_form(lines ARRAY<STRING>, grid BOOLEAN, colour STRING)",
        "STRUCT<family: STRING, ballot_type: STRING, reason: STRING>",
        _let(
            "t",
            "upper(array_join(lines, ' '))",
            f"CASE WHEN {s.title_type('t')} IS NOT NULL THEN named_struct('family', 'lg2026', 'ballot_type', {s.title_type('t')}, 'reason', 'title') "
            + r"""WHEN contains(t, 'TEST PARTY') THEN named_struct('family', 'lg2026', 'ballot_type', coalesce(colour, 'District Council PR'), 'reason', 'test_party')
            WHEN grid THEN named_struct('family', 'iec2024', 'ballot_type', CAST(NULL AS STRING), 'reason', 'result_grid')
            WHEN t RLIKE '\\b(NATIONAL|PROVINCIAL|REGIONAL)\\s+BALLOT\\b|RESULT SLIP' THEN named_struct('family', 'iec2024', 'ballot_type', CAST(NULL AS STRING), 'reason', 'iec_title')
            WHEN colour IS NOT NULL THEN named_struct('family', 'lg2026', 'ballot_type', colour, 'reason', 'colour_bar')
            ELSE named_struct('family', 'iec2024', 'ballot_type', CAST(NULL AS STRING), 'reason', 'default_iec') END""",
        ),
    ),
    ("barcode_of(texts ARRAY<STRING>, lines ARRAY<STRING>, vd STRING, family STRING)", "STRING", f"nullif(coalesce(get(filter(transform(texts, t -> {s.barcode_hit(s.barcode_repair('t', 'vd'), 'family')}), h -> h <> ''), 0), barcode_hit(barcode_repair(array_join(lines, ''), vd), family)), '')"),
    (
        "identity_of(lines ARRAY<STRING>)",
        "STRUCT<voting_district: STRING, registered_voters: INT, municipality: STRING, province: STRING, officer: STRING, page: STRUCT<n: INT, total: INT>>",
        _let(
            "t",
            "array_join(lines, ' ')",
            rf"""named_struct('voting_district', nullif(regexp_extract(t, '(?i)\\bVD\\s*:?\\s*([0-9]{{8}})\\b', 1), ''), 'registered_voters', try_cast(nullif(regexp_extract(t, '(?i)Registered\\s*Voters[:\\s]*([0-9]{{2,5}})', 1), '') AS INT),
            'municipality', coalesce({_place(r"(DC[0-9]{2})\\s*[-–]\\s*([A-Za-z][A-Za-z\\s-]{2,40})", r"\\bWard\\b|\\bVoting\\b")}, {_place(r"(KZN[0-9]{3})\\s*[-–]\\s*([A-Za-z][A-Za-z\\s-]{2,40})", r"\\bWard\\b|\\bVoting\\b")}),
            'province', IF(upper(t) RLIKE 'KZN|UMGUNGUNDLOVU', 'KwaZulu-Natal', NULL),
            'officer', nullif(trim(split(trim(regexp_replace(regexp_extract(t, '(?i)(?:Name of Counting Officer|Counting Officer Name)\\s*[:|]?\\s*([A-Za-z][A-Za-z\\s\']{{3,40}})', 1), '\\s+', ' ')), '(?i)\\bCounting\\b|\\bSignature\\b|\\bNote\\b')[0]), ''), 'page', {s.page_marker('t')})""",
        ),
    ),
    # Records: references, flags.
    ("election_of(kind STRING)", "STRING", "IF(kind = 'Provincial', '2024 PROVINCIAL ELECTION', '2024 NATIONAL ELECTION')"),
    ("slip_ref(barcode STRING, vd STRING, kind STRING, page INT)", "STRING", "coalesce(nullif(barcode, ''), concat(coalesce(nullif(vd, ''), 'UNREAD'), '_', upper(left(kind, 3)), '_p', page))"),
    ("unread_ref(path STRING)", "STRING", "concat('UNREAD_', upper(left(sha2(path, 256), 8)))"),
    (
        "page_flags(rows ARRAY<STRUCT<votes: INT, conf: DOUBLE, signed: BOOLEAN, overflow: BOOLEAN, disagree: BOOLEAN>>, n INT, registered INT, cast_votes INT)",
        "ARRAY<STRING>",
        _let(
            "total",
            "aggregate(rows, 0, (s, r) -> s + r.votes)",
            """filter(array(IF(exists(rows, r -> r.overflow), 'votes_exceed_registered', NULL), IF(exists(rows, r -> r.disagree), 'ocr_engine_disagreement', NULL), IF(exists(rows, r -> r.votes > 0 AND r.conf < 0.72D), 'low_confidence_digits', NULL),
            IF(exists(rows, r -> r.conf < 0.4D), 'unreadable_digits', NULL), IF(exists(rows, r -> r.votes = 0 AND r.signed), 'signature_on_zero_vote_row', NULL), IF(n >= 8 AND total = 0, 'no_votes_read', NULL),
            IF(registered > 0 AND total > registered, 'party_sum_exceeds_registered', NULL), IF(registered > 0 AND cast_votes > registered, 'cast_exceeds_registered', NULL)), f -> f IS NOT NULL)""",
        ),
    ),
    # Tokens.
    (
        "box_item(t STRING, score DOUBLE, points ARRAY<ARRAY<DOUBLE>>)",
        ITEM,
        _let(
            "p",
            "coalesce(points, array())",
            """named_struct('text', coalesce(t, ''), 'score', coalesce(score, 0D), 'cx', coalesce(aggregate(p, 0D, (s, q) -> s + q[0]) / nullif(size(p), 0), 0D), 'cy', coalesce(aggregate(p, 0D, (s, q) -> s + q[1]) / nullif(size(p), 0), 0D),
            'x1', coalesce(array_min(transform(p, q -> q[0])), 0D), 'x2', coalesce(array_max(transform(p, q -> q[0])), 0D), 'y1', coalesce(array_min(transform(p, q -> q[1])), 0D), 'y2', coalesce(array_max(transform(p, q -> q[1])), 0D))""",
        ),
    ),
    (
        f"cell_votes(items ARRAY<{ITEM}>, y1 DOUBLE, y2 DOUBLE, x1 DOUBLE, x2 DOUBLE)",
        "STRUCT<votes: INT, conf: DOUBLE>",
        _let(
            "hits",
            "array_sort(transform(filter(items, i -> i.cy BETWEEN y1 AND y2 AND i.cx BETWEEN x1 AND x2), i -> named_struct('cx', i.cx, 'text', i.text, 'score', i.score)))",
            _let(
                "bits",
                r"filter(hits, h -> trim(h.text) RLIKE '^[0-9OoØÓDIl|\\s.,:/_-]{1,16}$')",
                _let(
                    "conf",
                    "aggregate(bits, 0D, (s, h) -> s + h.score) / nullif(size(bits), 0)",
                    _let(
                        "votes",
                        s.vote_digits("array_join(transform(bits, h -> h.text), ' ')"),
                        "CASE WHEN size(hits) = 0 THEN named_struct('votes', 0, 'conf', 0.58D) WHEN size(bits) = 0 THEN named_struct('votes', 0, 'conf', 0.42D) WHEN votes IS NULL THEN named_struct('votes', 0, 'conf', greatest(0.28D, least(0.45D, conf * 0.5D))) ELSE named_struct('votes', votes, 'conf', greatest(0.2D, least(0.92D, conf))) END",
                    ),
                ),
            ),
        ),
    ),
    (f"header_bottom(items ARRAY<{ITEM}>, height DOUBLE)", "DOUBLE", "array_max(transform(filter(items, i -> regexp_replace(upper(i.text), '[^A-Z]', '') = 'RESULT' AND i.cy BETWEEN height * 0.16D AND height * 0.38D), i -> i.y2))"),
    (f"row_hits(items ARRAY<{ITEM}>, label {ITEM})", "ARRAY<STRUCT<cx: DOUBLE, votes: INT>>", _row_hits("label")),
    (
        f"token_totals(items ARRAY<{ITEM}>, width DOUBLE)",
        "STRUCT<valid: INT, spoilt: INT, cast: INT, special: INT, s24a: INT>",
        "named_struct(" + ", ".join(f"'{k}', {_total(p, k in ('valid', 'cast'))}" for k, p in (("valid", r"TOTAL\\s+VALID\\s+VOTES"), ("spoilt", r"TOTAL\\s+SPOILT\\s+VOTES"), ("cast", r"TOTAL\\s+VOTES\\s+CAST"), ("special", r"TOTAL\\s+SPECIAL\\s+VOTES"), ("s24a", r"SECTION\\s*7"))) + ")",
    ),
    (
        f"number_on_row(items ARRAY<{ITEM}>, y1 DOUBLE, y2 DOUBLE, x1 DOUBLE, x2 DOUBLE, target DOUBLE)",
        "STRUCT<votes: INT, conf: DOUBLE>",
        _let(
            "hits",
            f"array_sort(filter(transform(filter(items, i -> i.cx BETWEEN x1 AND x2 AND abs(i.cy - coalesce(target, (y1 + y2) / 2)) <= greatest(14D, y2 - y1) * 0.48D), i -> named_struct('dy', abs(i.cy - coalesce(target, (y1 + y2) / 2)), 'cx', i.cx, 'votes', {s.open_votes('i.text')}, 'score', i.score)), h -> h.votes IS NOT NULL))",
            _let(
                "row",
                "slice(array_sort(transform(hits, h -> named_struct('cx', h.cx, 'votes', h.votes, 'score', h.score))), 1, 4)",
                "CASE WHEN size(hits) = 0 THEN named_struct('votes', CAST(NULL AS INT), 'conf', 0D) WHEN size(hits) >= 2 AND forall(row, h -> h.votes < 10) THEN named_struct('votes', CAST(array_join(transform(row, h -> string(h.votes)), '') AS INT), 'conf', greatest(0.45D, least(0.92D, array_max(transform(row, h -> h.score))))) ELSE named_struct('votes', get(hits, 0).votes, 'conf', greatest(0.45D, least(0.92D, get(hits, 0).score))) END",
            ),
        ),
    ),
    (
        f"vote_column(items ARRAY<{ITEM}>, width INT, kind STRING)",
        "STRUCT<x1: INT, x2: INT>",
        _let(
            "h",
            r"array_max(transform(filter(items, i -> trim(i.text) RLIKE '(?i)^votes?$'), i -> named_struct('weight', i.y2 * i.score, 'x1', i.x1, 'x2', i.x2)))",
            "CASE WHEN h IS NOT NULL THEN named_struct('x1', greatest(0, CAST(h.x1 - greatest(18, CAST((h.x2 - h.x1) * 0.85D AS INT)) AS INT)), 'x2', least(width, CAST(h.x2 + greatest(18, CAST((h.x2 - h.x1) * 0.85D AS INT)) * 1.6D AS INT))) WHEN kind = 'Ward' THEN named_struct('x1', CAST(width * 0.50D AS INT), 'x2', CAST(width * 0.72D AS INT)) ELSE named_struct('x1', CAST(width * 0.42D AS INT), 'x2', CAST(width * 0.62D AS INT)) END",
        ),
    ),
    (f"name_right(items ARRAY<{ITEM}>, width INT, kind STRING)", "INT", f"IF(kind = 'Ward', CAST(coalesce(array_max(transform(filter(items, i -> i.text RLIKE '{_WARD}'), i -> i.x2)) + width * 0.02D, width * 0.50D) AS INT), CAST(width * 0.42D AS INT))"),
    ("snap_code(token STRING, codes ARRAY<STRING>, used ARRAY<STRING>)", "STRING", _snap("token", "codes", "used")),
    # Rows in order of height; one with the code of the row kept before it, less than 12 below, is the same row.
    (
        f"distinct_rows(rows ARRAY<{PARTY}>)",
        f"ARRAY<{PARTY}>",
        f"aggregate(array_sort(rows, (a, b) -> CASE WHEN a.cy < b.cy THEN -1 WHEN a.cy > b.cy THEN 1 ELSE 0 END), CAST(array() AS ARRAY<{PARTY}>), (kept, r) -> IF(abs(r.cy - try_element_at(kept, -1).cy) < 12 AND r.party_code = try_element_at(kept, -1).party_code, kept, concat(kept, array(r))))",
    ),
    (
        f"party_rows(items ARRAY<{ITEM}>, kind STRING, height DOUBLE)",
        f"ARRAY<{PARTY}>",
        f"""distinct_rows(CASE WHEN kind = 'Ward' THEN aggregate(filter(items, i -> i.cy BETWEEN height * 0.08D AND height * 0.86D AND NOT i.text RLIKE '{_NO_ROW}' AND i.text RLIKE '{_WARD}'), CAST(array() AS ARRAY<{PARTY}>), (rows, i) ->
        {_let("c", _snap(f"regexp_extract(i.text, '{_WARD}', 1)", _texts(WARD_CODES), "transform(rows, r -> r.party_code)"), "IF(c IS NULL OR exists(rows, r -> r.party_code = c), rows, concat(rows, array(named_struct('party_name', c, 'party_code', c, 'cy', i.cy, 'y1', i.y1, 'y2', i.y2, 'label', i))))")})
        ELSE transform(filter(items, i -> i.cy BETWEEN height * 0.08D AND height * 0.88D AND NOT i.text RLIKE '{_NO_ROW}' AND i.text RLIKE '{_TEST_PARTY}'), i -> named_struct('party_name', concat('IEC TEST PARTY ', upper(regexp_extract(i.text, '{_TEST_PARTY}', 1))), 'party_code', upper(regexp_extract(i.text, '{_TEST_PARTY}', 1)), 'cy', i.cy, 'y1', i.y1, 'y2', i.y2, 'label', i)) END)""",
    ),
    # Bands of rows meet half way; the first and the last reach as far outside as inside.
    (
        "row_bands(cy ARRAY<DOUBLE>, tall ARRAY<DOUBLE>, height INT)",
        "ARRAY<STRUCT<y1: INT, y2: INT>>",
        """transform(cy, (y, i) -> named_struct('y1', greatest(0, CAST(IF(i > 0, (cy[i - 1] + y) / 2, y - coalesce(get(cy, 1) - y, greatest(28D, tall[i])) / 2) AS INT)),
        'y2', least(height, CAST(IF(i < size(cy) - 1, (y + get(cy, i + 1)) / 2, y + IF(i > 0, y - cy[greatest(i - 1, 0)], greatest(28D, tall[i])) / 2) AS INT))))""",
    ),
    (
        f"band_name(items ARRAY<{ITEM}>, y1 DOUBLE, y2 DOUBLE, label_x DOUBLE, width DOUBLE)",
        "STRING",
        rf"""nullif(btrim(regexp_replace(array_join(transform(array_sort(transform(filter(items, i -> i.cy >= y1 AND i.cy < y2 AND i.x1 >= width * 0.10D AND i.x2 < label_x - 2 AND trim(i.text) <> '' AND NOT i.text RLIKE '{_NO_ROW}' AND NOT trim(i.text) RLIKE '^[0-9OØIlCcZz\\s]{{1,5}}$' AND NOT i.text RLIKE '{_WARD}' AND NOT i.text RLIKE '{_TEST_PARTY}'),
        i -> named_struct('cy', i.cy, 'x1', i.x1, 'text', trim(i.text)))), b -> b.text), ' '), '\\s+', ' '), ' -'), '')""",
    ),
    ("aligned_rows(lines ARRAY<INT>, n INT)", "ARRAY<STRUCT<y1: INT, y2: INT>>", _aligned()),
    # Values in order join the cluster before them while they are near its running centre.
    (
        "running_clusters(v ARRAY<DOUBLE>, gap DOUBLE)",
        "ARRAY<STRUCT<centre: DOUBLE, n: INT>>",
        """aggregate(array_sort(v), CAST(array() AS ARRAY<STRUCT<centre: DOUBLE, n: INT>>), (k, x) -> IF(x - try_element_at(k, -1).centre <= gap, concat(slice(k, 1, size(k) - 1),
        array(named_struct('centre', (try_element_at(k, -1).centre * try_element_at(k, -1).n + x) / (try_element_at(k, -1).n + 1), 'n', try_element_at(k, -1).n + 1))), concat(k, array(named_struct('centre', x, 'n', 1)))))""",
    ),
    ("edge_at(at DOUBLE, slope DOUBLE, y_ref DOUBLE, y DOUBLE)", "DOUBLE", "at + slope * (y - y_ref)"),
    ("digit_token(t STRING)", "STRING", "regexp_replace(translate(trim(coalesce(t, '')), 'ØøΦφOoIlSsBb了', '0000001155887'), '[^0-9]', '')"),
    # Presentation.
    ("as_json_text(a ARRAY<STRING>)", "STRING", "IF(size(a) > 0, to_json(a), NULL)"),
    ("iso_utc(t TIMESTAMP)", "STRING", r"date_format(t, 'yyyy-MM-dd\'T\'HH:mm:ss\'Z\'')"),
    ("shown(t STRING)", "STRING", "coalesce(nullif(t, ''), '—')"),
    ("shown_conf(c DOUBLE)", "STRING", "IF(c IS NULL, '—', format_string('%.2f', c))"),
    ("turnout_text(cast_votes INT, registered INT)", "STRING", "IF(coalesce(registered, 0) = 0, '0.0', format_string('%.1f', 100D * coalesce(cast_votes, 0) / registered))"),
    ("duration_text(seconds DOUBLE)", "STRING", "concat(string(CAST(greatest(0D, round(coalesce(seconds, 0D))) AS BIGINT) DIV 60), ':', lpad(string(CAST(greatest(0D, round(coalesce(seconds, 0D))) AS BIGINT) % 60), 2, '0'))"),
    # Seconds from now, rounded step by step: (amount, unit).
    (
        "relative_time(seconds BIGINT)",
        "STRUCT<n: BIGINT, unit: STRING>",
        _let(
            "m",
            "CAST(floor(seconds / 60D + 0.5D) AS BIGINT)",
            _let(
                "h",
                "CAST(floor(m / 60D + 0.5D) AS BIGINT)",
                _let(
                    "d",
                    "CAST(floor(h / 24D + 0.5D) AS BIGINT)",
                    _let("mo", "CAST(floor(d / 30D + 0.5D) AS BIGINT)", "CASE WHEN abs(seconds) < 60 THEN named_struct('n', seconds, 'unit', 'second') WHEN abs(m) < 60 THEN named_struct('n', m, 'unit', 'minute') WHEN abs(h) < 24 THEN named_struct('n', h, 'unit', 'hour') WHEN abs(d) < 30 THEN named_struct('n', d, 'unit', 'day') WHEN abs(mo) < 12 THEN named_struct('n', mo, 'unit', 'month') ELSE named_struct('n', CAST(floor(mo / 12D + 0.5D) AS BIGINT), 'unit', 'year') END"),
                ),
            ),
        ),
    ),
    ("status_label(s STRING)", "STRING", "coalesce(element_at(map('pending_review', 'Ready', 'incomplete', 'Missing pages', 'approved', 'Approved', 'rejected', 'Rejected', 'flagged', 'Flagged'), s), replace(coalesce(s, ''), '_', ' '))"),
    ("ballot_class(kind STRING)", "STRING", "regexp_replace(regexp_replace(lower(coalesce(kind, '')), '[^a-z0-9]+', '-'), '^-|-$', '')"),
]


def register(spark: SparkSession) -> None:
    """Makes these functions and those of scalars.py known to the session, once."""
    s.register(spark)
    s.declare(spark, "forms", FUNCTIONS)
