
from tallyweave.functions.fusion import fuse
from tallyweave.functions.scalars import register

#: Inputs and results that must match; the barcodes of both families and the repairs at the end are our own.
GOLDEN = [
    ("vote_digits('0 1')", 1), ("vote_digits('Ø 5')", 5), ("vote_digits('12345')", 2345), ("vote_digits('5|2')", 52), ("vote_digits('φφφ9')", 9), ("vote_digits('ØØ18')", 18), ("vote_digits('')", None),
    ("family_base('AB (2)')", "AB"), ("copy_number('AB (7)')", 7), ("next_copy(array(2, 3, 5))", 4), ("flag_list('nope')", []), ("norm_key(' a-b#1')", "AB#1"),
    ("barcode_parts(barcode_hit(barcode_repair('001334762402341011', NULL), NULL)).ballot_type", "National"), ("barcode_parts(barcode_hit('001334762402343011', NULL)).voting_district", "76240234"),
    ("local_type(substring(barcode_hit('011965439600246012', 'lg2026'), 15, 1))", "District Council PR"), ("page_marker('x Page 2  of 3').total", 3),
    ("open_votes('I5')", 15), ("open_votes('VS731')", 731), ("open_votes('2513195')", 3195), ("open_votes('8b')", 98), ("open_votes('bb')", 99), ("open_votes('6于')", 67), ("open_votes('CC')", 22), ("open_votes('Z2')", 22), ("open_votes('2C')", 22),
    ("choose_votes(8, 98, 0)", 98), ("choose_votes(0, 100, 0)", 100), ("choose_votes(67, 6, 0)", 67), ("choose_votes(9, 94, 0)", 9), ("choose_votes(NULL, 99, 0)", 99), ("choose_votes(7, 707, 0)", 7), ("choose_votes(0, 7001, 0)", 0), ("choose_votes(60, 600, 0)", 60), ("choose_votes(3, 22, 2)", 22), ("choose_votes(9, 94, 1)", 9),
    ("fit_votes(600, 2)", 60), ("fit_votes(100, 3)", 100), ("fit_votes(10, 1)", 0), ("fit_votes(160, 3)", 160), ("fit_votes(98, 2)", 98),
    ("dash_noise(1111)", True), ("dash_noise(903)", True), ("dash_noise(18)", False), ("dash_noise(481)", False), ("dash_noise(2212)", True),
    ("dash_inflated(1512, 52)", True), ("dash_inflated(18, 10)", False), ("dash_inflated(481, 48)", False), ("extra_digit(287, 27)", True), ("extra_digit(39, 9)", True), ("extra_digit(222, 22)", True), ("extra_digit(481, 48)", False), ("extra_digit(72, 2)", True), ("extra_digit(91, 1)", True), ("extra_digit(13, 1)", False),
    ("peel_rule(2218)", 18), ("peel_rule(2127)", 27), ("peel_rule(1006)", 6), ("peel_rule(218)", None), ("peel_rule(1816)", None), ("peel_rule(2187)", 27),
    ("box_votes(array(0, 1, null, null)).votes", 1), ("box_votes(array(4, 8, 1, null)).votes", 481), ("box_votes(array(8, null, null, null)).votes", 0), ("box_votes(array(0, null, 7, null)).votes", 0), ("box_votes(array(null, 7, 7, null)).votes", 0), ("box_votes(array(7, 7, null, null)).votes", 77), ("box_votes(array(null, 8, 1, 6)).votes", 816), ("box_votes(array(null, null, null, 1)).votes", 1),
    ("barcode_parts(barcode_hit('011965439600243012', 'lg2026'), 'lg2026').ballot_type", "Local Council PR"), ("barcode_parts(barcode_hit('011965439600244022', 'lg2026'), 'lg2026').page_number", 2), ("barcode_parts(barcode_hit('011965439600244022', 'lg2026'), 'lg2026').page_total", 2), ("barcode_parts('', 'lg2026')", None), ("barcode_parts(NULL)", None),
    ("barcode_parts(barcode_hit('999999123456786013', 'lg2026'), 'lg2026').ballot_type_code", "6"), ("barcode_parts(barcode_hit('999999123456781013', NULL), 'iec2024').page_total", 3),
    ("cell_labels(array(1, 2, 3))", None), ("percent_done(1D, 8D, 0D)", 12), ("remaining_s(10D, 1D, 2D, 0D)", 10.0),
]

#: Readings and results that must match.
FUSED = [
    (0, 0.90, 9, 0.92, 0.20, 165, 9, True), (481, 0.80, 81, 0.91, 0.20, 1149, 481, False), (481, 0.80, 48, 0.92, 0.20, 1149, 481, False), (48, 0.80, 481, 0.91, 0.20, 1149, 481, True), (52, 0.80, 1512, 0.90, 0.22, 3080, 52, False), (100, 0.80, 9, 0.92, 0.20, 165, 9, True), (27, 0.80, 287, 0.90, 0.22, 3080, 27, False), (9, 0.80, 39, 0.90, 0.20, 165, 9, False), (77, 0.80, 772, 0.92, 0.22, 1149, 77, False), (0, 0.90, 903, 0.91, 0.20, 1149, 0, False),
    (1816, 0.80, 1814, 0.92, 0.20, 3080, 1816, False), (0, 0.90, 1816, 0.91, 0.20, 3080, 1816, True), (2, 0.80, 72, 0.90, 0.18, 3080, 2, False), (3, 0.80, 27, 0.66, 0.16, 3080, 27, True), (10, 0.80, 18, 0.84, 0.20, 165, 18, True), (10, 0.80, 218, 0.79, 0.04, None, 18, True), (10, 0.80, 818, 0.85, 0.04, None, 18, True), (10, 0.74, 2218, 0.825, 0.04, 0, 18, True), (0, 0.87, 1006, 0.65, 0.04, 0, 6, True), (3, 0.67, 2127, 0.778, 0.16, 3080, 27, True),
    (9, 0.80, 4, 0.92, 0.20, 165, 9, False), (0, 0.90, 7, 0.92, 0.014, 3080, 7, True), (5, 0.80, 2, 0.92, 0.18, 3080, 2, True), (7, 0.80, 3, 0.92, 0.18, 3080, 3, True), (11, 0.80, 41, 0.92, 0.18, 3080, 41, True), (14, 0.80, 15, 0.92, 0.18, 3080, 15, True), (48, 0.80, 52, 0.92, 0.18, 3080, 52, True),
]


def test_golden(spark):
    register(spark)
    row = spark.range(1).selectExpr(*[f"{e} AS c{i}" for i, (e, _) in enumerate(GOLDEN)]).first()
    assert [(e, v) for (e, _), v in zip(GOLDEN, row)] == GOLDEN


def test_fusion(spark):
    df = spark.createDataFrame([x[:6] for x in FUSED], "icr int, icr_conf double, rapid int, rapid_conf double, ink double, registered int")
    got = [(r.icr, r.rapid, r.votes, r.used_rapid) for r in fuse(df).collect()]
    assert sorted(got) == sorted((x[0], x[2], x[6], x[7]) for x in FUSED)
