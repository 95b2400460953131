from tabularium.schema import DOCS, LINES, WORDS
from tabularium.sources import positioned


def words(spark, *rows):
    """``page, text, x0, top`` in flow order."""
    return spark.createDataFrame([("d", p, i, x, float(a), float(a) + 20.0, float(y)) for i, (p, x, a, y) in enumerate(rows)], WORDS)


def docs(spark):
    return spark.createDataFrame([("d", "Example", "Recipe One", "http://x")], DOCS)


HEAD = [(0, "Powder", 60, 100.0), (0, "Charge", 170, 100.0), (0, "Velocity", 230, 100.0), (0, "Charge", 300, 100.0), (0, "Velocity", 360, 100.0)]


def row(y, name, *cells):
    return [(0, name, 60, y)] + [(0, c, x, y) for c, x in zip(cells, (171, 231, 301, 361)) if c]


def test_sections(spark):
    table = [(0, "Bullet", 60, 80.0), (0, "Weight:", 90, 80.0), (0, "150", 125, 80.0), *HEAD]
    table += row(120.0, "*PowderA", "42.0", "2500", "455", "2700")[:4] + [(0, "45.5", 301, 120.0), (0, "2700", 361, 120.5)]
    table += row(130.0, "PowderB", "40.0", "2400", "44.0c", "2600") + row(140.0, "PowderC", "40.0", "2400", "", "") + row(150.0, "PowderD", "40.0", "2400", "39.0", "2600")
    table += [(0, "Weight", 60, 200.0), (0, "SKU", 170, 200.0), (0, "Type", 100, 200.0), (0, "69gr.", 61, 215.0), (0, "Match", 100, 215.0), *row(230.0, "Late", "1", "2", "3", "4")]
    lines = spark.createDataFrame([("d", 0, "Case: Brass  Primer: Small Rifle  COAL 2.5")], LINES)
    got = positioned.from_section_words(words(spark, *table), lines, docs(spark)).orderBy("table_ord", "line_ord").collect()
    assert [(r["powder"], r["charge_min_gr"], r["charge_max_gr"], r["velocity_min_fps"], r["velocity_fps"], r["flags"]) for r in got] == [("PowderA", 42.0, 45.5, 2500.0, 2700.0, "most accurate"), ("PowderB", 40.0, 44.0, 2400.0, 2600.0, "compressed")]
    assert {(r["bullet_weight_gr"], r["case_name"], r["primer"], r["coal_in"], r["table_ord"]) for r in got} == {(150.0, "Brass", "Small Rifle", "2.5", 0)}


def test_section_triggers(spark):
    table = [(0, "150-grain", 40, 10), (0, "Soft", 70, 11), (0, "x", 90, 11), (0, "Point", 40, 20), (0, "Density", 70, 20), (0, "Weight", 60, 200), (0, "SKU", 170, 200), (0, "Type", 100, 200), (0, "69gr.", 61, 215), (0, "Match", 100, 215), (0, "Burner", 130, 215), (0, "70gr.", 61, 351)]
    got = positioned.section_triggers(words(spark, *table)).orderBy("top").collect()
    assert [(r["top"], r["weight"], r["kind"]) for r in got] == [(10.0, 150.0, "Soft Point"), (215.0, 69.0, "Match Burner")]


def test_unpaired_header(spark):
    lines = spark.createDataFrame([], LINES)
    (r,) = positioned.from_section_words(words(spark, *HEAD, *row(120.0, "P", "1", "20", "3", "40"), *row(130.0, "PowderA", "", "20", "3", "40")), lines, docs(spark)).filter("powder != ''").collect()
    assert (r["powder"], r["bullet_weight_gr"], r["bullet_type"], r["coal_in"]) == ("PowderA", None, "", None)


def test_grid(spark):
    spec = [(0, "Case:", 10, 10), (0, "Old", 50, 10), (0, "Case:", 10, 30), (0, "Fed", 50, 31), (0, "Brass", 80, 30), (0, "Barrel", 10, 50), (0, "Length:", 40, 50), (0, '24"', 70, 50), (0, "DRAFT", -5, 30)]
    page = [(1, "Bullet", 10, 10), (1, "#1", 10, 20), (1, "90", 40, 20), (1, "gr", 60, 20), (1, "HP", 80, 20), (1, '2.5"', 120, 20), (1, "#2", 10, 30), (1, "110gr.", 40, 30), (1, "SP", 80, 30)]
    page += [(1, "Powder", 10, 100), (1, "Velocity", 60, 100), (1, "2000", 100, 101), (1, "2100", 150, 101), (1, "H", 10, 120), (1, "4895", 30, 120), (1, "30.1", 100, 121), (1, "*32.0*", 151, 120), (1, "99", 180, 120), (1, "Energy", 10, 140), (1, "H", 10, 150), (1, "1", 100, 150)]
    got = positioned.from_grid_words(words(spark, *spec, *page), docs(spark)).orderBy("line_ord").collect()
    assert [(r["powder"], r["charge_gr"], r["velocity_fps"], r["is_max"]) for r in got] == [("H 4895", 30.1, 2000.0, False), ("H 4895", 32.0, 2100.0, True)]
    assert {(r["bullet_type"], r["case_name"], r["barrel"], r["twist"]) for r in got} == {("90gr HP / 110gr SP", "Fed Brass", '24"', "")}


def test_recipes(spark):
    new = [(0, "165", 10, 40), (0, "gr", 30, 40), (0, "GDHP", 50, 40), (0, "4397", 90, 40), (0, "Propellant", 10, 100), (0, "Case", 100, 100), (0, "Primer", 150, 100), (0, "Grain", 200, 100), (0, "Velocity", 250, 100), (0, "Grain", 300, 100), (0, "Velocity", 350, 100)]
    new += [(0, "Alpha", 10, 120), (0, "5", 30, 121), (0, "Fed", 100, 120), (0, "5.0", 200, 120), (0, "900", 252, 120), (0, "5.5", 300, 120), (0, "C", 320, 120), (0, "990", 352, 120), (0, "Beta", 10, 130), (0, "5.0", 200, 130), (0, "900", 250, 130)]
    old = [(1, "Soft", 50, 30), (1, "Point", 70, 30), (1, "Weight", 10, 50), (1, "115", 60, 50), (1, "Propellant", 10, 100), (1, "Case", 100, 100), (1, "Primer", 150, 100), (1, "Weight", 200, 100), (1, "Velocity", 250, 90), (1, "Weight", 300, 100), (1, "Velocity", 350, 90), (1, "Gamma", 10, 120), (1, "4.0", 200, 120), (1, "800", 250, 120), (1, "890", 350, 120)]
    lines = spark.createDataFrame([("d", 0, 'Max Case Length: 0.754"  Test Firearm: Pistol ')], LINES)
    got = positioned.from_recipe_words(words(spark, *new, *old), lines, docs(spark)).orderBy("table_ord").collect()
    assert [(r["powder"], r["charge_min_gr"], r["charge_max_gr"], r["velocity_fps"], r["flags"]) for r in got] == [("Alpha 5", 5.0, 5.5, 990.0, "compressed"), ("Gamma", 4.0, None, 890.0, "")]
    assert [(r["bullet_weight_gr"], r["bullet_type"], r["case_name"], r["test_firearm"], r["notes"]) for r in got] == [(165.0, "GDHP", '0.754"', "Pistol", "Recipe One"), (115.0, "Soft Point", '0.754"', "Pistol", "Recipe One")]
