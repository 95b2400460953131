"""Queries that print ordinary tables in the layouts of publishers and recover them again.

What is printed of ``part`` is known, so the recovered lines have a SQL twin that never sees the print. Six parts make
a document, and a part is a row, a table or a page of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators.pieces import dealt
from tabularium.plans.catalogue import query, read
from tabularium.plans.lookup import HARVEST_DOCS, LISTING, PUBLISHERS, Shelf, lookup, lookup_many
from tabularium.schema import WORDS
from tabularium.session import settled
from tabularium.sources import listings, positioned, publishers

_FACTS = """
f as (select cast(p_partkey // 6 as varchar) as doc_id, p_partkey // 6 as doc, cast(p_partkey % 6 as integer) as k, p_partkey as key, p_size as size, cast(floor(p_retailprice) as bigint) as price from part),
g as (select *, size || '.' || key % 10 as c1, (size + 5) || '.' || key % 10 as c2, 1000 + key % 500 as v, 100 + key % 100 as w, dense_rank() over (partition by doc_id order by k) - 1 as table_ord from f)"""


#: Parts that one task prints and reads again at most, but for those of one document; a part is some 35 words.
PARTS_EACH = 20_000


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document, place in it, and the numbers to be printed of each part.

    Parts are narrow and lie in few files, what is printed of them is wide: they are dealt out by document before anything
    is printed, in as many tasks as there are parts for, so that printing is no work of a few tasks and its words need not be dealt out again.
    """
    key = F.col("p_partkey")
    doc = F.floor(key / 6)
    part = read(spark, sf_dir, "part")
    at = part.select(doc.cast("string").alias("doc_id"), doc.alias("doc"), (key % 6).cast("int").alias("k"), key.alias("key"), F.col("p_size").alias("size"), F.floor("p_retailprice").cast("long").alias("price"))
    at = dealt(at, ["doc_id"], part.count(), PARTS_EACH)
    text = lambda *c: F.concat_ws("", *[F.lit(x) if isinstance(x, str) else x for x in c])
    last = F.col("key") % 10
    return at.withColumns({"c1": text(F.col("size"), ".", last), "c2": text(F.col("size") + 5, ".", last), "v": 1000 + F.col("key") % 500, "w": 100 + F.col("key") % 100})


def documents(rows: DataFrame, item: str) -> DataFrame:
    return rows.select("doc_id").distinct().select("doc_id", F.lit("Example").alias("cartridge"), F.lit(item).alias("item_name"), F.concat(F.lit("http://x/"), "doc_id").alias("source_url"))


def lines_of(rows: DataFrame, *line: Column) -> DataFrame:
    """One line of text a document."""
    return rows.select("doc_id", "doc").distinct().select("doc_id", F.lit(0).alias("line_no"), F.concat(*line).alias("line"))


def words(rows: DataFrame, *placed: tuple) -> DataFrame:
    """A word for each ``(page, text, x0, top)``, in flow order; null texts are not printed."""
    col = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    every = F.array(*[F.struct(col(p, "int").alias("page"), F.lit(i).alias("seq"), col(t, "string").alias("text"), col(x, "double").alias("x0"), (col(x, "double") + 20).alias("x1"), col(y, "double").alias("top")) for i, (p, t, x, y) in enumerate(placed)])
    return rows.select("doc_id", F.explode(F.filter(every, lambda w: w["text"].isNotNull())).alias("w")).select("doc_id", "w.*")


def layout_texts(f: DataFrame) -> DataFrame:
    """``doc_id, value``: text tables, a part a row."""
    named = F.concat(F.lit("Powder "), "size", F.lit("      "), "c1", F.lit("   MAX.   "), "price", F.lit("   99   98%"))
    plain = F.concat(F.lit("            "), "c1", F.when(F.col("key") % 2 == 0, "    **    ").otherwise("          "), "price", F.lit("   99   97%"))
    row = F.concat(F.when(F.col("k") % 3 == 0, named).otherwise(plain), F.when(F.col("k") == 5, "\r\nSee the manual for MAX. loads").otherwise(""))
    body = f.groupBy("doc_id", "doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", row.alias("x")))), lambda s: s["x"]), "\r\n").alias("body"))
    coal = F.when(F.col("doc") % 2 == 0, F.concat(F.lit("TESTED O.A.C.L. 2."), "doc", F.lit("\n"))).otherwise("")
    return body.select("doc_id", F.concat(F.lit("CASE TYPE: Case"), "doc", F.lit(" x\nPRIMER TYPE  Small Rifle "), "doc", F.lit(" \n"), coal, "body").alias("value"))


def sheet_files(f: DataFrame) -> DataFrame:
    """``doc_id, value``: sheets as CSV, a part a table."""
    bullet = F.concat(F.lit(",†"), "w", F.lit("gr Bullet "), "key", F.lit(",Twist rate or faster 1-"), "size", F.lit(",,"), F.when(F.col("key") % 5 > 0, F.concat(F.lit(".15"), F.col("key") % 5)).otherwise(""), F.when(F.col("key") % 3 == 0, ",√1.75,\n").otherwise(",,\n"))
    data = F.concat(F.lit(",Powder "), "size", F.lit(","), "c1", F.lit(',"9\n0",'), "v", F.lit(",,"), "price", F.when(F.col("key") % 2 == 0, " c•\n").otherwise("\n"))
    part = F.concat(bullet, F.lit(",Powder,Start,Fill %,F.P.S.,,Velocity at Max\n"), data, F.lit(",Powder without numbers,,,,,\n,Always start low and work up,,,,,\n,,,,,,\n"))
    body = f.groupBy("doc_id", "doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", part.alias("x")))), lambda s: s["x"]), "").alias("body"))
    return body.select("doc_id", F.concat(F.lit(',,,,,,\n,22 Example,"Barrel Length 2'), F.col("doc") % 10, F.lit('""",,,"Case 1.4""",SAAMI COAL\n'), "body").alias("value"))


_FORM = ("doc_id", "table_ord", "line_ord", "powder", "flags", "is_max")


@query(f"""
with {_FACTS},
r as (select *, last_value(case when k % 3 = 0 then 'Powder ' || size end ignore nulls) over (partition by doc_id order by k rows between unbounded preceding and current row) as powder from g)
select doc_id, row_number() over (partition by doc_id order by k) - 1 as line_ord, powder, cast(c1 as double) as charge, cast(price as double) as velocity, k % 3 = 0 as is_max,
       case when k % 3 <> 0 and key % 2 = 0 then 'most accurate' else '' end as flags, 'Case' || doc as case_name, 'Small Rifle ' || doc as primer, case when doc % 2 = 0 then '2.' || doc end as coal_in, 115.0::double as weight, '115 gr Round' as kind
from r where powder is not null""")
def extract_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text tables: a powder stands on its MAX. row alone."""
    f = facts(spark, sf_dir)
    out = publishers.from_layout_text(publishers.text_lines(layout_texts(f)), documents(f, "115 gr Round"))
    return out.select("doc_id", "line_ord", "powder", F.col("charge_gr").alias("charge"), F.col("velocity_fps").alias("velocity"), "is_max", "flags", "case_name", "primer", "coal_in", F.col("bullet_weight_gr").alias("weight"), F.col("bullet_type").alias("kind"))


@query(f"""
with {_FACTS}
select doc_id, table_ord, 0::bigint as line_ord, 'Powder ' || size as powder, case when key % 2 = 0 then 'compressed, long drop tube' else '' end as flags, true as is_max,
       cast(c1 as double) as charge_min, cast(v as double) as velocity_min, cast(price as double) as velocity, cast(w as double) as weight, w || 'gr Bullet ' || key as kind,
       case when key % 3 = 0 then '1.75' end as coal_in, case when key % 5 > 0 then 'BC .15' || key % 5 else '' end as notes, '1-' || size as twist, '2' || doc % 10 || '"' as barrel, '1.4"' as case_name
from g""")
def extract_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed sheets: heading, bullets, table heads, rows, and notes to be skipped, as CSV with quoted line ends."""
    f = facts(spark, sf_dir)
    out = publishers.from_sheets(publishers.csv_rows(sheet_files(f)), documents(f, ""))
    return out.select(*_FORM, F.col("charge_min_gr").alias("charge_min"), F.col("velocity_min_fps").alias("velocity_min"), F.col("velocity_fps").alias("velocity"), F.col("bullet_weight_gr").alias("weight"), F.col("bullet_type").alias("kind"), "coal_in", "notes", "twist", "barrel", "case_name")


@query(f"""
with {_FACTS},
l as (select *, unnest([{{'n': 0, 'p': 'H ' || size, 'v': v, 'c': c1, 'top': false}}, {{'n': 1, 'p': 'H ' || size, 'v': v + 100, 'c': c2, 'top': false}}, {{'n': 2, 'p': 'H ' || size, 'v': v + 200, 'c': '99', 'top': true}}, {{'n': 3, 'p': 'Varget', 'v': v + 100, 'c': c1, 'top': true}}]) as x from g),
s as (select doc_id from f where k = 0)
select l.doc_id, table_ord, cast(x.n as bigint) as line_ord, x.p as powder, cast(x.c as double) as charge, cast(x.v as double) as velocity, x.top as is_max, w || 'gr HP' || case when key % 2 = 1 then ' / 110gr SP' else '' end as kind,
       case when s.doc_id is null then '' else 'Fed Brass' || doc end as case_name, case when s.doc_id is null then '' else '24"' end as barrel
from l left join s on s.doc_id = l.doc_id""")
def extract_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid pages: charges under velocities, specifications on the first page, a watermark off the page."""
    f, page = facts(spark, sf_dir), F.col("k") + 1
    first, odd = (lambda x: F.when(F.col("k") == 0, x)), (lambda x: F.when(F.col("key") % 2 == 1, x))
    spec = [(0, first("Case:"), 10, 10), (0, first("Old"), 50, 10), (0, first("Case:"), 10, 30), (0, first("Fed"), 50, 31), (0, first(F.concat(F.lit("Brass"), "doc")), 80, 30), (0, first("Barrel"), 10, 50), (0, first("Length:"), 40, 50), (0, first('24"'), 70, 50), (0, first("DRAFT"), -5, 30)]
    bullets = [(page, "Bullet", 10, 10), (page, "#1", 10, 20), (page, F.col("w"), 40, 20), (page, "gr", 60, 20), (page, "HP", 80, 20), (page, '2.5"', 120, 20), (page, odd("#2"), 10, 30), (page, odd("110gr."), 40, 30), (page, odd("SP"), 80, 30)]
    head = [(page, "Powder", 10, 100), (page, "Velocity", 60, 100), (page, F.col("v"), 100, 101), (page, F.col("v") + 100, 150, 101), (page, F.col("v") + 200, 200, 100)]
    rows = [(page, "H", 10, 120), (page, F.col("size"), 30, 120), (page, F.col("c1"), 100, 121), (page, F.concat(F.lit("*"), "c2", F.lit("*")), 151, 120), (page, "98", 180, 120), (page, "99", 202, 120), (page, "Varget", 10, 132), (page, F.col("c1"), 149, 132)]
    below = [(page, "Energy", 10, 140), (page, "H", 10, 150), (page, "1", 100, 150)]
    out = positioned.from_grid_words(words(f, *spec, *bullets, *head, *rows, *below), documents(f, ""))
    return out.select("doc_id", "table_ord", "line_ord", "powder", F.col("charge_gr").alias("charge"), F.col("velocity_fps").alias("velocity"), "is_max", F.col("bullet_type").alias("kind"), "case_name", "barrel")


@query(f"""
with {_FACTS},
l as (select *, unnest([{{'n': 0, 'p': 'Alpha ' || size, 'c': c2, 'f': case when key % 2 = 0 then 'compressed' else '' end}}, {{'n': 1, 'p': 'Gamma', 'c': null, 'f': ''}}]) as x from g)
select doc_id, table_ord, cast(x.n as bigint) as line_ord, x.p as powder, x.f as flags, true as is_max, cast(c1 as double) as charge_min, cast(v as double) as velocity_min, cast(x.c as double) as charge_max, cast(v + 90 as double) as velocity_max,
       cast(w as double) as weight, case when key % 5 = 0 then 'Soft Point' else 'GDHP' end as kind, '0.7' || doc % 10 || '"' as case_name, 'Pistol ' || doc as test_firearm, 'Recipe One' as notes
from l""")
def extract_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipe pages of either template; rows of two numbers are no loads."""
    f, page = facts(spark, sf_dir), F.col("k")
    old = F.col("key") % 5 == 0
    new_, old_ = (lambda x: F.when(~old, x)), (lambda x: F.when(old, x))
    top = [(page, new_(F.col("w")), 10, 40), (page, new_("gr"), 30, 40), (page, new_("GDHP"), 50, 40), (page, new_("4397"), 90, 40), (page, old_("Soft"), 50, 30), (page, old_("Point"), 70, 30), (page, old_("Weight"), 10, 50), (page, old_(F.col("w")), 60, 50)]
    unit, speed = F.when(old, "Weight").otherwise("Grain"), F.when(old, 92).otherwise(100)
    head = [(page, "Propellant", 10, 100), (page, "Case", 100, 100), (page, "Primer", 150, 100), (page, unit, 200, 100), (page, "Velocity", 250, speed), (page, unit, 300, 100), (page, "Velocity", 350, speed)]
    rows = [(page, "Alpha", 10, 120), (page, F.col("size"), 30, 121), (page, "Fed", 100, 120), (page, F.col("c1"), 200, 120), (page, F.col("v"), 252, 120), (page, F.col("c2"), 300, 120), (page, F.when(F.col("key") % 2 == 0, "C"), 320, 120), (page, F.col("v") + 90, 352, 120)]
    rows += [(page, "Beta", 10, 130), (page, F.col("c1"), 200, 130), (page, F.col("v"), 250, 130), (page, "Gamma", 10, 140), (page, F.col("c1"), 201, 140), (page, F.col("v"), 249, 140), (page, F.col("v") + 90, 351, 140)]
    lines = lines_of(f, F.lit("Max Case Length: 0.7"), F.col("doc") % 10, F.lit('"  Test Firearm: Pistol '), F.col("doc"), F.lit(" "))
    out = positioned.from_recipe_words(words(f, *top, *head, *rows), lines, documents(f, "Recipe One"))
    return out.select(*_FORM, F.col("charge_min_gr").alias("charge_min"), F.col("velocity_min_fps").alias("velocity_min"), F.col("charge_max_gr").alias("charge_max"), F.col("velocity_fps").alias("velocity_max"), F.col("bullet_weight_gr").alias("weight"), F.col("bullet_type").alias("kind"), "case_name", "test_firearm", "notes")


@query(f"""
with {_FACTS},
h as (select *, lead(key) over (partition by doc_id order by k) as after from g),
l as (select *, unnest([{{'n': 0, 'p': 'Powder' || size, 'c': c2, 'f': array_to_string(list_filter([case when key % 2 = 0 then 'most accurate' end, case when key % 3 = 0 then 'compressed' end, case when key % 5 = 0 then 'compressed' end], lambda y: y is not null), ', ')}}, {{'n': 1, 'p': 'Late Max', 'c': null, 'f': ''}}]) as x from h)
select doc_id, table_ord, cast(x.n as bigint) as line_ord, x.p as powder, x.f as flags, true as is_max, cast(c1 as double) as charge_min, cast(v as double) as velocity_min, cast(x.c as double) as charge_max, cast(v + 90 as double) as velocity_max,
       cast(w as double) as weight, case key % 3 when 0 then case when key % 2 = 0 then 'Flat' else '' end when 1 then 'Soft Point' else 'Match' end as kind,
       case when key % 4 = 0 then 'Own' || key when after % 4 = 0 and after % 3 <> 2 then 'Own' || after else 'Case' || doc end as case_name, 'Small Rifle' as primer, '2.' || doc as coal_in
from l""")
def extract_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of several pages: each head takes its own bullet, words printed twice count once, falling rows are no loads.

    Bullets are told in a line, in a sidebar or in a table of references. Some sections have a case of their own, which also
    stands in the section before, as that reaches to the next head or table of references.
    """
    f, page = facts(spark, sf_dir), F.col("k")
    form = lambda k: lambda x: F.when(F.col("key") % 3 == k, x)
    line, side, table = map(form, range(3))
    own, flat = (lambda x: F.when(F.col("key") % 4 == 0, x)), (lambda x: F.when(F.col("key") % 6 == 0, x))
    head = [(page, line("Bullet"), 60, 80), (page, line("Weight:"), 90, 80), (page, line(F.col("w")), 125, 80), (page, flat("Style:"), 60, 86), (page, flat("Flat"), 95, 87), (page, flat("Base"), 130, 86)]
    head += [(page, side(F.concat("w", F.lit("-Grain"))), 40, 80), (page, side("Soft"), 80, 81), (page, side("Density"), 110, 81), (page, side("Point"), 40, 90)]
    head += [(page, table("Weight"), 60, 70), (page, table("SKU"), 170, 70), (page, table("Type"), 100, 70), (page, table(F.concat("w", F.lit("gr."))), 61, 80), (page, table("Match"), 100, 81)]
    head += [(page, own("Case:"), 200, 92), (page, own(F.concat(F.lit("Own"), "key")), 240, 92), (page, "Powder", 60, 100), (page, "Charge", 170, 100), (page, "Velocity", 230, 100), (page, "Charge", 300, 100), (page, "Velocity", 360, 100)]
    star, squeezed, too = F.when(F.col("key") % 2 == 0, "*").otherwise(""), F.when(F.col("key") % 3 == 0, "c").otherwise(""), F.when(F.col("key") % 5 == 0, "C").otherwise("")
    rows = [(page, F.concat(star, F.lit("Powder"), "size"), 60, 120), (page, F.concat("c1", too), 171, 120), (page, F.col("v"), 231, 120), (page, F.concat(F.replace("c2", F.lit("."), F.lit("")), squeezed), 301, 120), (page, F.concat("c2", squeezed), 301, 120), (page, F.col("v") + 90, 361, 120.5)]
    rows += [(page, "Falling", 60, 130), (page, F.col("c2"), 171, 130), (page, F.col("v"), 231, 130), (page, F.col("c1"), 301, 130), (page, F.col("v") + 90, 361, 130)]
    rows += [(page, "Late", 60, 140), (page, "Max", 85, 140), (page, "x", 110, 140), (page, F.col("c1"), 171, 140), (page, F.col("v"), 231, 140), (page, F.col("v") + 90, 361, 140), (page, "Two", 60, 150), (page, F.col("c1"), 171, 150), (page, F.col("v"), 231, 150)]
    lines = lines_of(f, F.lit("Case: Case"), F.col("doc"), F.lit("  Primer: Small Rifle  COAL 2."), F.col("doc"))
    out = positioned.from_section_words(words(f, *head, *rows), lines, documents(f, ""))
    return out.select(*_FORM, F.col("charge_min_gr").alias("charge_min"), F.col("velocity_min_fps").alias("velocity_min"), F.col("charge_max_gr").alias("charge_max"), F.col("velocity_fps").alias("velocity_max"), F.col("bullet_weight_gr").alias("weight"), F.col("bullet_type").alias("kind"), "case_name", "primer", "coal_in")


def _pages(f: DataFrame, part: Column, before: Column | str = "", after: Column | str = "") -> DataFrame:
    """``page_ord, html``: what each part prints, in order, a page a document."""
    one = f.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", part.alias("x")))), lambda s: s["x"]), "").alias("body"))
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return one.select(F.col("doc").alias("page_ord"), F.concat(col(before), "body", col(after)).alias("html"))


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) and x not in ("key", "size", "k", "w") else F.col(x).cast("string") if isinstance(x, str) else x for x in parts])


@query(f"""
with {_FACTS},
r as (select *, table_ord as spot, sum((key % 3 <> 1)::int) over (partition by doc order by k) - 1 as inner_at from g)
select 'nosler' as source, doc * 4294967296 + inner_at::bigint as ord, 'Round ' || key as label, 'http://n/' || key as url, null as sheet_id from r where key % 3 = 0
union all select 'sierra', doc * 4294967296 + spot, 'Round' || key || '&®–éé', case when key % 3 = 0 then 'https://sierrabullets.com/x/load-data/' || key || '.PDF' else 'https://s/LOAD-DATA/' || key || '.pdf' end, null from r where key % 3 <> 1
union all select 'barnes', doc * 4294967296 + spot, 'Round ' || key, 'https://barnesbullets.com/Barnes-LoadData/' || key || '.pdf', null from r where key % 3 = 0
union all select 'hammer', doc * 4294967296 + spot, 'Round ' || key, 'https://docs/spreadsheets/d/ID_' || key || '-x/edit', 'ID_' || key || '-x' from r where key % 2 = 0""")
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of four publishers: containers in containers, paths, notes to be cut, sheets; links that are none of these."""
    f, kind = facts(spark, sf_dir), F.col("key") % 3
    # Attributes of other names, values without quotes, and links in comments and scripts are all around.
    quote = F.element_at(F.array(F.lit('"'), F.lit("'"), F.lit("")), (F.col("key") % 3 + 1).cast("int"))
    link = lambda href, label: F.concat(F.lit('<!-- <a href="/load-data/no.pdf">no</a> --><script>"<a href=/load-data/no.pdf>no</a>"</script><a data-href="/load-data/wrong.pdf" class=x HREF = '), quote, href, quote, F.lit(">"), label, F.lit("</a>"))
    box = lambda x: F.concat(F.lit('<div class="x load-data-tab-container"><div><p>'), x, F.lit("</div><br></div>"))
    mine, name = link(_said("http://n/", "key"), _said(" Round ", "key", " ")), _said("Round ", "key")
    pages = {
        "nosler": F.when(kind == 0, box(mine)).when(kind == 1, mine).otherwise(box(link(_said("/n/", "key"), name))),
        "sierra": link(F.when(kind == 0, _said("/x/load-data/", "key", ".PDF")).when(kind == 1, _said("/load-data/", "key", ".html")).otherwise(_said("https://s/LOAD-DATA/", "key", ".pdf")), _said(" Round <b> ", "key", "</b>&amp; <i>&reg;&#8211;&#xe9;&eacute;</i>")),
        "barnes": link(F.when(kind == 0, _said("/Barnes-LoadData/", "key", ".pdf")).when(kind == 1, _said("/barnes-loaddata/Recall-", "key", ".pdf")).otherwise(_said("/other/", "key", ".pdf")), _said("Round ", "key", "- This link will open a PDF document")),
        "hammer": link(F.when(F.col("key") % 2 == 0, _said("https://docs/spreadsheets/d/ID_", "key", "-x/edit")).otherwise(_said("/d/", "key")), name),
    }
    return reduce(DataFrame.unionByName, [listings.list_items(_pages(f, part), source) for source, part in pages.items()])


@query(f"""
with {_FACTS},
r as (select *, sum((key % 4 <> 2)::int) over (partition by doc order by k) - 1 as ord from g)
select doc as page_ord, cast(ord as integer) as ord, w || ' Grain' as name, case when key % 2 = 0 then 'http://n/' else 'https://www.nosler.com/' end || key || '.PDF' as pdf_url from r where key % 4 < 2""")
def second_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first link of every tab, where it is a document; tabs without links, and links after the first, give none."""
    base = F.when(F.col("key") % 2 == 0, "http://n/").otherwise("/")
    inner = F.when(F.col("key") % 4 == 2, F.lit("<b>none</b>")).otherwise(F.concat(F.lit('<span><a href="'), base, "key", F.when(F.col("key") % 4 == 3, ".html").otherwise(".PDF"), F.lit('"></a></span><a href="/late.pdf">x</a>')))
    pages = _pages(facts(spark, sf_dir), F.concat(_said('<li data-tab-name="', "w", ' Grain">'), inner, F.lit("</li><a href='/out.pdf'>o</a>")))
    return listings.second_hop(pages).select("page_ord", "ord", "name", "pdf_url")


@query(f"""
with {_FACTS},
e as (select doc, 0 as kind, table_ord * 2 + unnest([0, 1]) as spot, size, 'R' || key as name, '/' || key || '.pdf' as url from g union all select doc, 1, table_ord, size, 'Round ' || size || ' 150', '/old/' || key || '.pdf' from g)
select size || ' round' as key, 'Round ' || size as label, count(*) as n, md5(string_agg(name || url, '|' order by doc, kind, spot)) as recipes from e group by size""")
def recipe_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes of embedded JSON and older links, under one entry a name, none dropped."""
    f = facts(spark, sf_dir).withColumns({"cartridge": _said('{"value":"c', "k", '","label":"Round ', "size", '"}'), "recipe": _said('{"name":"R', "key", '","pdf_url":"/', "key", '.pdf","cartridge":["c', "k", '","Round ', "size", '"]}')})
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda s: s[c]), ",")
    data = f.groupBy("doc").agg(F.concat(F.lit('<script>var recipeJson = {"cartridges":['), listed("cartridge"), F.lit('],"recipes":['), listed("recipe"), F.lit("]}; var more = {};</script>")).alias("head"))
    pages = _pages(f, _said('<a href="/old/', "key", '.pdf">Round&nbsp;', "size", " 150</a>")).join(data.withColumnRenamed("doc", "page_ord"), "page_ord")
    entries = listings.recipe_entries(pages.select("page_ord", F.concat("head", "html").alias("html")))
    merged = listings.merge_catalogue(entries, ["page_ord", "kind", "ord"])
    return merged.select("key", "label", F.size("recipes").cast("long").alias("n"), F.md5(F.array_join(F.transform("recipes", lambda r: F.concat(r["name"], r["pdf_url"])), "|").cast("binary")).alias("recipes"))


_NAMES = ", ".join(f"({i}, '{n}', '{PUBLISHERS[n].name}')" for i, n in enumerate(("hammer", "barnes", "nosler", "sierra", "speer")))


@query(f"""
with {_FACTS},
h as (select count(*) as n from g where doc % 40 = 7 and doc % 3 <> 0),
e as (select string_agg('failed to fetch/parse http://x/' || doc_id || ': HTTP 500', '; ' order by doc_id) as e from (select distinct doc, doc_id from f) where doc % 40 = 7 and doc % 3 = 0),
n as (select count(*) as n from f where doc = 7),
s as (select * from (values {_NAMES}) s(pos, source, manufacturer))
select pos, source, manufacturer, 'round 7' as query, case when source in ('barnes', 'sierra') then null else 'Round 7' end as matched,
       case source when 'hammer' then h.n when 'nosler' then 1 else 0 end as n_tables, case source when 'hammer' then h.n when 'nosler' then n.n else 0 end as n_lines,
       case source when 'hammer' then coalesce(e, '') when 'barnes' then 'could not load cartridge list: HTTP 503' when 'sierra' then 'no matching cartridge found' when 'speer' then 'failed to load cartridge page http://p: HTTP 404' else '' end as errors,
       case source when 'hammer' then e is null when 'nosler' then true else false end as ok
from s, h, e, n""")
def lookup_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sources asked for one name: counts, what matched, and what went wrong at each step."""
    found = lookup(_shelf(spark, sf_dir), "round 7", ["hammer", "barnes", "nosler", "sierra", "speer"])
    return found.results.withColumn("errors", F.array_join("errors", "; "))


def _shelf(spark: SparkSession, sf_dir: str) -> Shelf:
    """Rounds 0 to 39 of two publishers, some of whose documents failed; others have no listing, other names, or a failed page."""
    f = facts(spark, sf_dir)
    # Listings and documents read the documents' names a dozen times.
    doc, none = settled(f.select("doc_id", "doc").distinct()), F.lit(None).cast("string")
    label = F.concat(F.lit("Round "), F.col("doc") % 40)
    entry = lambda source, name: doc.select(F.lit(source).alias("source"), F.col("doc").alias("ord"), name.alias("label"), F.lit("u").alias("url"), none.alias("error"))
    listing = entry("nosler", label).unionByName(entry("hammer", label)).unionByName(entry("speer", label)).unionByName(entry("sierra", F.concat(F.lit("Square "), 100 + F.col("doc"))))
    listing = listing.unionByName(spark.createDataFrame([("barnes", -1, None, "u", "HTTP 503")], LISTING))
    mine = lambda source, order, error: doc.select("doc_id", F.lit(source).alias("source"), order.cast("long").alias("ord"), label.alias("cartridge"), F.lit("").alias("item_name"), F.concat(F.lit("http://x/"), "doc_id").alias("source_url"), F.lit("document").alias("stage"), error.alias("error"))
    docs = mine("nosler", F.col("doc"), none).unionByName(mine("hammer", F.lit(None), F.when(F.col("doc") % 3 == 0, "HTTP 500")))
    docs = docs.unionByName(spark.createDataFrame([("p", "speer", None, "Round 7", None, "http://p", "page", "HTTP 404")], HARVEST_DOCS))
    return Shelf(listing, docs, lambda only: publishers.text_lines(layout_texts(only(f))), spark.createDataFrame([], WORDS), lambda only: publishers.csv_rows(sheet_files(only(f))))


@query(f"""
with {_FACTS},
q as (select distinct doc % 40 as r from f),
h as (select doc % 40 as r, count(*) filter (doc % 3 <> 0) as n from g group by 1),
e as (select doc % 40 as r, string_agg('failed to fetch/parse http://x/' || doc_id || ': HTTP 500', '; ' order by doc_id) as e from (select distinct doc, doc_id from f) where doc % 3 = 0 group by 1),
n as (select doc as r, count(*) as n from f where doc < 40 group by 1),
s as (select * from (values {_NAMES}) s(pos, source, manufacturer))
select q.r as query_id, pos, source, manufacturer, 'Round ' || q.r as query, case when source in ('barnes', 'sierra') then null else 'Round ' || q.r end as matched,
       case source when 'hammer' then h.n when 'nosler' then 1 else 0 end as n_tables, case source when 'hammer' then h.n when 'nosler' then n.n else 0 end as n_lines,
       case source when 'hammer' then coalesce(e, '') when 'barnes' then 'could not load cartridge list: HTTP 503' when 'sierra' then 'no matching cartridge found'
                   when 'speer' then case when q.r = 7 then 'failed to load cartridge page http://p: HTTP 404' else '{PUBLISHERS["speer"].nothing}' end else '' end as errors,
       case source when 'hammer' then e is null when 'nosler' then true else false end as ok
from q join h using (r) left join e using (r) join n using (r), s""")
def lookup_many_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sources asked for every round that parts name, in one plan."""
    asked = facts(spark, sf_dir).select((F.col("doc") % 40).alias("query_id")).distinct().withColumn("text", F.concat(F.lit("Round "), "query_id"))
    found = lookup_many(_shelf(spark, sf_dir), asked, ["hammer", "barnes", "nosler", "sierra", "speer"])
    return found.results.withColumn("errors", F.array_join("errors", "; "))
