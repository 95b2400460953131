"""Harvest over HTTP from a server of this machine, with readers that stand in for the parsers of PDF."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tabularium.__main__ import main
from tabularium.plans.harvest import harvest
from tabularium.plans.lookup import lookup
from tabularium.plans.report import fetched
from tabularium.sources import documents, html, listings, web

TEXT = "CASE TYPE: Brass x\nPowderX      30.0   MAX.   2500   99   98%\n             29.0          2400   99   95%\n"
SHEET = ",,,,,,\n,22 Example,\"Barrel Length 24\"\"\",,,\"Case 1.403\"\"\",SAAMI\n,30gr Bullet,Twist rate or faster 1-14,,.150,1.750,\n,Powder,Start,Fill %,F.P.S.,,Velocity at Max\n,PowderY†,10.0,90,2500,,2870 c\n"


def grid():
    rows = [(1, "Powder", 10, 100), (1, "Velocity", 60, 100), (1, "2000", 100, 101), (1, "H", 10, 120), (1, "30.1", 100, 121)]
    pages = [[], [{"text": t, "x0": x, "x1": x + 20, "top": y} for _, t, x, y in rows]]
    return json.dumps(pages).encode()


@pytest.fixture(scope="module")
def site():
    seen = []

    class Pages(BaseHTTPRequestHandler):
        def answer(self, status, body, cookie=None):
            body = body if isinstance(body, bytes) else body.encode()
            self.send_response(status)
            if cookie:
                self.send_header("Set-Cookie", cookie)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            form = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            seen.append(("POST", form))
            self.answer(200, "ok", "age=1" if form.get("age_gate[age]") == ["abc="] and form.get("age_gate[confirm]") == ["1"] else None)

        def do_GET(self):
            seen.append((self.path, self.headers["User-Agent"]))
            base = f"http://{self.headers['Host']}"
            if self.path == "/nosler":
                return self.answer(200, f'<div class="a load-data-tab-container"><div><a href="{base}/page">9mm Luger</a></div><a href="{base}/other">9mm Luger</a><p><a href="/rel">223 Remington</a></div><a href="{base}/x">outside</a>')
            if self.path == "/page":
                return self.answer(200, f'<div data-tab-name="115 Grain"><span><a href="{base}/a.PDF">x</a><a href="{base}/no.pdf">y</a></span></div><div data-tab-name="none"></div><div data-tab-name="124 Grain"><a href="{base}/gone.pdf">x</a></div><div data-tab-name="web"><a href="{base}/a.html">x</a></div>')
            if self.path in ("/a.PDF", "/speer.pdf"):
                return self.answer(200, TEXT)
            if self.path == "/sierra":
                return self.answer(200, f'<a href="{base}/load-data/9.pdf"> 9mm Luger </a>')
            if self.path == "/load-data/9.pdf":
                return self.answer(200, grid())
            if self.path == "/hammer":
                if "age=1" not in (self.headers["Cookie"] or ""):
                    return self.answer(200, '<form><input type="hidden" name="age_gate[age]" value="abc="></form>')
                return self.answer(200, '<a href="https://docs/spreadsheets/d/ID-1/edit">9mm Luger</a>')
            if self.path == "/sheet/ID-1":
                return self.answer(200, SHEET)
            return self.answer(404, "no")

    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def _reader():
    """A function that is sent to executors by value, as this module is not there."""
    return lambda content: json.loads(content) if content[:1] == b"[" else []


read_json = _reader()


def getter(base):
    gate = web.Gate(f"{base}/hammer", (("age_gate[confirm]", "1"),), "age_gate[age]")
    return lambda requests: web.fetch(requests, (gate,), timeout=10)


@pytest.fixture()
def at(site, monkeypatch):
    from tabularium.plans import harvest as h

    base, _ = site
    monkeypatch.setattr(h, "SHEET_URL", base + "/sheet/{}")
    return {"pages": {n: [f"{base}/{n}"] for n in ("nosler", "sierra", "speer", "hammer", "barnes")}, "get": getter(base), "words": read_json, "text": bytes.decode}


def test_harvest_and_lookup(spark, site, at, tmp_path):
    base, seen = site
    names = ["nosler", "sierra", "hammer", "barnes"]
    shelf = harvest(spark, "9mm luger", str(tmp_path / "s"), names, cache=str(tmp_path / "c"), now=1000.0, **at)
    results, lines = fetched(lookup(shelf, "9mm luger", names))
    assert [(r["source"], r["n_lines"], r["ok"]) for r in results] == [("nosler", 2, False), ("sierra", 1, True), ("hammer", 1, True), ("barnes", 0, False)]
    assert list(results[0]["errors"]) == [f"failed to fetch/parse {base}/gone.pdf: HTTP Error 404: no"] or results[0]["errors"][0].startswith(f"failed to fetch/parse {base}/gone.pdf: HTTP Error 404")
    assert results[3]["errors"][0].startswith("could not load cartridge list: HTTP Error 404")
    assert [x["charge"] for x in lines["nosler"]] == ["30 gr (MAX)", "29 gr"] and lines["hammer"][0]["powder"] == "PowderY†"
    assert {a for p, a in seen if p != "POST"} == {web.AGENT} and ("POST", {"age_gate[confirm]": ["1"], "age_gate[age]": ["abc="]}) in seen
    # Listings are kept: a second harvest asks for documents only.
    before = len(seen)
    harvest(spark, "9mm luger", str(tmp_path / "t"), ["nosler", "sierra"], cache=str(tmp_path / "c"), now=2000.0, **at)
    assert not {"/nosler", "/sierra"} & {p for p, _ in seen[before:]}


def test_failed_page_of_an_entry(spark, site, at, tmp_path):
    base, _ = site
    (r,), _ = fetched(lookup(harvest(spark, "223 remington", str(tmp_path / "s"), ["nosler"], **at | {"pages": {"nosler": [f"{base}/nosler"]}}), "223 remington", ["nosler"]))
    assert list(r["errors"]) == ["no matching cartridge found"]  # a relative link is no entry


def test_command_line_harvests(spark, site, at, tmp_path, capsys):
    assert main([str(tmp_path / "s"), "9mm luger", "--sources", "sierra", "--harvest", "--no-report"], spark, **at) == 0
    assert "Sierra — 9mm Luger" in capsys.readouterr().out


def test_readers_fail_for_themselves(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(grid())
    (tmp_path / "b.pdf").write_bytes(b"[broken")
    files = documents.binary_files(spark, str(tmp_path))
    got = documents.words_of(files, read_json).collect()
    assert sorted((r["text"] or "", r["error"] is not None) for r in got) == [("", True), ("2000", False), ("30.1", False), ("H", False), ("Powder", False), ("Velocity", False)]
    assert all(r["error"] for r in documents.words_of(files).collect()) and all(r["error"] for r in documents.texts_of(files).collect())  # neither parser is installed


def test_elements(spark):
    page = '<div class="box"><a href="1">one</a><div class="x"><div class="box"><a href="2"> t<i> wo </i>&amp; </a></div></div><br><a href="3"></a></div><a href="4">out</a><div class="boxes"><a href="5">no</a></div>'
    pages = spark.createDataFrame([(7, page), (8, None), (9, ""), (10, "<div class='box'><a href=6>open")], "ord_ int, html string")
    got = [tuple(r) for r in html.links_inside(pages, "div", "box").orderBy("ord_", "ord").collect()]
    assert got == [(7, 0, "1", "one"), (7, 1, "2", "two&"), (7, 2, "3", ""), (7, 3, "2", "two&"), (10, 0, "6", "open")]
    assert html.links_inside(pages.limit(0), "div", "box").count() == 0
    tabs = spark.createDataFrame([(0, '<li data-tab-name="a"><b></b></li><li data-tab-name="b"><p><a href="/x.pdf"></a></p><a href="/y.pdf"></a></li>')], "page_ord int, html string")
    assert [tuple(r) for r in listings.second_hop(tabs).select("name", "pdf_url").collect()] == [("b", "https://www.nosler.com/x.pdf")]
    assert html.hidden_value('<input name="a"><input name="a" value="v">', "a") == "v" and html.hidden_value("", "a") is None
