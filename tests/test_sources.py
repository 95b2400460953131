import random

from pyspark.sql import functions as F

from tabularium.sources import html, listings, markup, publishers


def docs(spark, name="115 Grain"):
    return spark.createDataFrame([("d", "Example", name, "http://x")], "doc_id string, cartridge string, item_name string, source_url string")


def test_layout_text(spark):
    text = "\n".join(["CASE TYPE: Brass x", "PowderX      30.0   MAX.   2500   99   98%", "             29.0          2400   99   95%", "Most Accurate    28.0  *   2300   99   92%"])
    lines = publishers.text_lines(spark.createDataFrame([("d", text)], "doc_id string, value string"))
    got = publishers.from_layout_text(lines, docs(spark)).orderBy("line_ord").collect()
    assert [(r["powder"], r["charge_gr"], r["velocity_fps"], r["is_max"], r["flags"]) for r in got] == [("PowderX", 30.0, 2500.0, True, ""), ("PowderX", 29.0, 2400.0, False, ""), ("PowderX", 28.0, 2300.0, False, "most accurate")]
    assert (got[0]["case_name"], got[0]["bullet_weight_gr"], got[0]["bullet_type"], got[0]["coal_in"]) == ("Brass", 115.0, "", None)


def test_sheet(spark):
    sheet = ",,,,,,\n,22 Example,\"Barrel Length 24\"\"\",,,\"Case 1.403\"\"\",SAAMI COAL\n,†30gr BulletA,Twist rate or faster 1-14,,.150,√1.750,\n,30gr BulletB,Twist rate or faster 1-14,,.160,1.760,\n,Powder,Start,Fill %,F.P.S.,,Velocity at Max\n,PowderX,10.0,90,2500,,2870 c•\n,Always start low and work up,,,,,\n"
    rows = publishers.csv_rows(spark.createDataFrame([("d", sheet)], "doc_id string, value string"))
    (r,) = publishers.from_sheets(rows, docs(spark)).collect()
    assert (r["bullet_type"], r["bullet_weight_gr"], r["notes"], r["coal_in"], r["barrel"], r["case_name"], r["twist"]) == ("30gr BulletA", 30.0, "BC .150", "1.750", '24"', '1.403"', "1-14")
    assert (r["powder"], r["charge_min_gr"], r["velocity_min_fps"], r["velocity_fps"], r["flags"], r["is_max"]) == ("PowderX", 10.0, 2500.0, 2870.0, "compressed, long drop tube", True)


def test_recipes_and_merge(spark):
    html = '<script>var recipeJson = {"cartridges":[{"value":"c1","label":"Name One"}],"recipes":[{"name":"R1","pdf_url":"/a.pdf","cartridge":["c1","c9"]}]}; var x=1;</script><a href="/b.pdf">Name&nbsp;One 150</a>'
    pages = spark.createDataFrame([(0, html), (1, "<p>none</p>")], "page_ord int, html string")
    entries = listings.recipe_entries(pages)
    assert sorted((r["label"], r["name"], r["pdf_url"]) for r in entries.collect()) == [("Name One", "Name One 150", "/b.pdf"), ("Name One", "R1", "/a.pdf"), ("c9", "R1", "/a.pdf")]
    merged = {r["label"]: [x["pdf_url"] for x in r["recipes"]] for r in listings.merge_catalogue(entries, ["page_ord", "kind", "ord"]).collect()}
    assert merged == {"Name One": ["/a.pdf", "/b.pdf"], "c9": ["/a.pdf"]}


def test_listing_rules(spark):
    html = '<a href="/x/load-data/One.PDF">One</a><a href="/load-data/two.html">Two</a><a href="/load-data/three.pdf"><b></b></a>'
    got = listings.list_items(spark.createDataFrame([(0, html)], "page_ord int, html string"), "sierra").collect()
    assert [(r["label"], r["url"]) for r in got] == [("One", "https://sierrabullets.com/x/load-data/One.PDF")]


def test_cache(spark, tmp_path):
    items = spark.createDataFrame([("a", 0)], "label string, ord int")
    path = str(tmp_path / "c")
    assert listings.load_cache(spark, path, 0.0) is None
    listings.save_cache(items.filter(F.lit(False)), path, 100.0)
    assert listings.load_cache(spark, path, 100.0) is None
    listings.save_cache(items, path, 100.0)
    assert listings.load_cache(spark, path, 100.0 + listings.CACHE_SECONDS).count() == 1
    assert listings.load_cache(spark, path, 101.0 + listings.CACHE_SECONDS) is None


def test_cache_versions(spark, tmp_path):
    """Readers have the newest whole version, whatever is being written; what they began to read stays for them."""
    path = str(tmp_path / "c")
    rows = lambda *r: spark.createDataFrame(list(r), "label string, ord int")
    told = lambda now: sorted(map(tuple, listings.load_cache(spark, path, now).collect()), key=str)
    listings.save_cache(rows(("a", 0), (None, 1)), path, 100.0)
    reader = listings.load_cache(spark, path, 100.0)
    torn = tmp_path / "c" / "v-9999999999999999-x" / "_temporary"
    torn.mkdir(parents=True)
    (torn.parent / "part-0.parquet").write_bytes(b"half")
    assert told(100.0) == [("a", 0), (None, 1)]
    listings.save_cache(rows(("b", 2)), path, 200.0)
    assert told(200.0) == [("b", 2)] and reader.count() == 2
    listings.refresh_cache(rows(("b", 3), (None, 4)), path, 300.0, ["label"])
    assert told(300.0) == [("b", 3), (None, 4)]
    listings.refresh_cache(rows(("c", 5)), path, 400.0, ["label"])
    assert told(400.0) == [("b", 3), ("c", 5), (None, 4)]
    listings.refresh_cache(rows(), path, 500.0, ["label"])
    assert told(500.0 + listings.CACHE_SECONDS) == [("b", 3), ("c", 5), (None, 4)]
    assert len(listings._versions(spark, path)) == listings.KEPT_VERSIONS and torn.exists()
    listings.refresh_cache(rows(("n", 1)), str(tmp_path / "new"), 1.0, ["label"])
    assert listings.load_cache(spark, str(tmp_path / "new"), 1.0).count() == 1


PAGE = """<!DOCTYPE html><p>x < y &amp; z<br/>
<a data-href="/wrong.pdf" href="/right.pdf">R&reg; &#8211; &#xE9; &eacute; <b> bold </b></a>
<A class=x HREF=/bare.pdf?a=1&amp;b=2&copy=3>bare</A><!-- <a href="/no.pdf">no</a> --><a href='/q"uote.pdf' href="/last.pdf">last of two</a>
<script>"<a href='/script.pdf'>no</a>"</script><STYLE><a href=/style.pdf>no</style ><title><a href=/title.pdf>no</title>
<a href="/empty.pdf"></a><a name=none>no href</a><div><a href="/open.pdf">open <i>in</div> not in it
<a href="/nested.pdf">outer <a href="/inner.pdf">inner</a> rest</a></nothing><a href="/cut"""


def test_links_of_odd_markup(spark):
    pages = spark.createDataFrame([(1, PAGE, 0), (2, None, 0), (3, "", 0), (4, "<!-- never closed <a href=x>y</a>", 0), (5, "<script><a href=x>y</a>", 0), (6, "a <1> </> <?x?> <a\thref = ' /x '\n>&nbsp;y\u00a0</a", 0)], "page_id int, html string, href int").drop("href")
    got = {}
    for r in html.anchors(pages).orderBy("page_id", "ord").collect():
        got.setdefault(r["page_id"], []).append((r["ord"], r["href"], r["label"]))
    assert got[1] == [
        (0, "/right.pdf", "R® – é ébold"),
        (1, "/bare.pdf?a=1&b=2&copy=3", "bare"),
        (2, "/last.pdf", "last of two"),
        (3, "/empty.pdf", ""),
        (4, "/open.pdf", "openin"),
        (5, "/nested.pdf", "outerinnerrest"),
        (6, "/inner.pdf", "inner"),
    ]
    assert got[6] == [(0, " /x ", "y")] and got.keys() == {1, 6}


def test_tokens_are_those_of_a_parser():
    """Against the standard parser, on pages put together at random of well-formed pieces and odd text."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.got = []

        def handle_starttag(self, tag, attrs):
            self.got.append(("start", tag, {k: v or "" for k, v in attrs}))

        def handle_endtag(self, tag):
            self.got.append(("end", tag, None))

        def handle_data(self, data):
            self.got.append(("text", data, None))

    def joined(found):
        out = []
        for t in found:
            if t[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + t[1], None)
            elif t[1]:
                out.append(t)
        return out

    rng = random.Random(3)
    some = ["<p>", "</p>", "<a href=x>", '<a href="a b&amp;c" class=\'q\' data-x>', "</a>", "text ", "&eacute;&#233;&#xe9;&lt;b&gt;", "<br>", "<!-- <p> -->", "<!doctype html>", "a < b ", "<DIV ID = 7 >", "</DIV>", "\n", "&nosuch; & &#38;"]
    for _ in range(400):
        page = "".join(rng.choice(some) for _ in range(rng.randrange(20))) + "<hr>"
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert joined(markup.tokens(page)) == joined(plain.got), page


def test_odd_pages_take_linear_time():
    import time

    for page in ("<" * 400_000, "<p>" * 200_000 + "x</b>" * 100_000, '<a href="' * 100_000, "<a " + "b=c " * 200_000, "<!--" * 200_000, "</p" * 200_000, "&" * 400_000, "<a href=x>" + "<i>t" * 100_000 + "</i>" * 100_000, "<script>" + "</scrip" * 100_000):
        began = time.perf_counter()
        html._Walk(page)
        assert time.perf_counter() - began < 3, page[:20]
