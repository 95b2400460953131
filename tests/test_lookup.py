from datetime import datetime

import pytest

from tabularium.__main__ import main
from tabularium.plans import report
from tabularium.plans.lookup import SCHEMAS, Shelf, lookup, lookup_many, open_shelf, rows, save_shelf


@pytest.fixture(scope="module")
def shelf(spark):
    rows = {
        "listing": [("nosler", 0, "9mm Luger", "u", None), ("nosler", 1, "223 Remington", "u", None), ("nosler", 2, "9mm Luger", "v", None), ("hammer", 0, "9mm Luger", "u", None), ("sierra", 0, "45 Auto", "u", None), ("speer", -1, None, "u", "HTTP 503")],
        "docs": [
            ("n1", "nosler", 0, "9mm Luger", "115 Grain", "http://n1", "document", None),
            ("n2", "nosler", None, "9mm Luger", "124 <Grain>", "http://n2", "document", "HTTP 500"),
            ("n3", "nosler", 2, "9mm Luger", "147 Grain", "http://n3", "document", "of the second entry of that label"),
            ("h1", "hammer", 0, "9mm Luger", "", "http://h1", "document", None),
            ("s1", "sierra", 0, "45 Auto", None, "http://s", "page", "HTTP 404"),
        ],
        "lines": [("n1", 0, "CASE TYPE: Brass x"), ("n1", 1, "P<1>      30.0   MAX.   2500   99   98%"), ("n1", 2, "Powder      30.0   MAX.   2500   99   98%"), ("n1", 3, "             29.0     *     2400   99   95%")],
        "words": [],
        "sheet_rows": [],
    }
    return Shelf(**{n: spark.createDataFrame(rows[n], s) for n, s in SCHEMAS.items()})


def test_results_keep_the_order_and_errors(shelf):
    results, lines = report.fetched(lookup(shelf, "9mm luger", ["sierra", "nosler", "hammer", "barnes"]))
    assert [(r["source"], r["matched"], r["n_lines"]) for r in results] == [("sierra", None, 0), ("nosler", "9mm Luger", 2), ("hammer", "9mm Luger", 0), ("barnes", None, 0)]
    assert [list(r["errors"]) for r in results] == [["no matching cartridge found"], ["failed to fetch/parse http://n2: HTTP 500"], ["sheet fetched but no load tables had data yet (Hammer marks some as not-yet-published)"], ["could not load cartridge list: nothing harvested"]]
    assert [(r["charge"], r["velocity"]) for r in lines["nosler"]] == [("30 gr (MAX)", "2500 fps"), ("29 gr", "2400 fps")]


def test_first_entry_failed_pages_and_listings(shelf):
    results, _ = report.fetched(lookup(shelf, "9mm luger", ["nosler", "speer"]))
    assert [(list(r["errors"]), r["ok"]) for r in results] == [(["failed to fetch/parse http://n2: HTTP 500"], False), (["could not load cartridge list: HTTP 503"], False)]
    (r,), _ = report.fetched(lookup(shelf, "45 auto", ["sierra"]))
    assert list(r["errors"]) == ["failed to load cartridge page http://s: HTTP 404"] and not r["ok"]


def test_many_names_are_looked_up_as_one_by_one(spark, shelf):
    """Names that share documents, odd ones, and none: the same lines, counts and errors, from one plan."""
    names = ["9mm luger", "9mm Luger", "45 auto", "223 rem", "nothing of these", ""]
    asked = spark.createDataFrame([*enumerate(names), (0, names[0]), (99, None)], "query_id int, text string")
    found = lookup_many(shelf, asked)
    got, lines = {}, {}
    for r in found.results.orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append(tuple(r)[1:])
    for r in found.lines.collect():
        lines.setdefault(r["query_id"], []).append(tuple(r)[1:])
    assert got.keys() == {*range(len(names)), 99} and {r[4] for r in got[99]} == {None}
    for k, name in enumerate(names):
        one = lookup(shelf, name)
        assert got[k] == [tuple(r) for r in one.results.orderBy("pos").collect()]
        assert sorted(lines.get(k, []), key=str) == sorted(map(tuple, one.lines.collect()), key=str)
    assert lookup_many(shelf, asked.limit(0)).results.count() == 0


def test_rows_have_eight_columns(shelf):
    got = rows(lookup(shelf, "9mm luger", ["nosler"]).lines)
    assert got.columns == ["powder", "charge_gr", "charge_min_gr", "charge_max_gr", "velocity_fps", "velocity_min_fps", "is_max", "flags"] and got.count() == 2


def test_unknown_source(shelf):
    with pytest.raises(ValueError, match="unknown source"):
        lookup(shelf, "9mm luger", ["nobody"])


def test_report_escapes_and_warns(shelf, tmp_path):
    found = report.fetched(lookup(shelf, "9mm luger", ["nosler", "hammer"]))
    path = report.write_report("<9mm>", *found, str(tmp_path / "r"), datetime(2024, 1, 2, 3, 4, 5))
    html = open(path, encoding="utf-8").read()
    assert path.endswith("9mm-20240102-030405.html") and "<9mm>" not in html and "&lt;9mm&gt;" in html
    assert report.WARNING in html and "Nosler 2<" in html and "class=empty-link>Hammer Bullets 0<" in html and "No data — sheet fetched" in html
    assert html.index('id="nosler"') < html.index('id="hammer-bullets"') and 'class="green">most accurate' in html


def test_command_line(spark, shelf, tmp_path, capsys, monkeypatch):
    save_shelf(shelf, str(tmp_path / "s"))
    assert open_shelf(spark, str(tmp_path / "s")).docs.count() == 5
    assert main([str(tmp_path / "s"), "9mm luger", "--sources", "nosler", "--no-open", "--report-dir", str(tmp_path / "r")], spark) == 0
    said = capsys.readouterr().out
    assert "Nosler — 9mm Luger, 115gr" in said and "  ! failed to fetch/parse http://n2: HTTP 500" in said and "Page written to " in said
    assert main([str(tmp_path / "s"), "45 auto", "--sources", "nosler", "--no-report"], spark) == 1
    answers = iter(["9mm luger", "q"])
    monkeypatch.setattr("builtins.input", lambda _: next(answers))
    assert main([str(tmp_path / "s"), "--sources", "nosler", "--no-report"], spark) == 0
