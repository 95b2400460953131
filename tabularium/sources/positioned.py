"""Extraction from positioned words: three page layouts, to the flat fact of load lines.

Every step is an equi join or a window within one page or document; rows of print are recovered by anchored clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabularium.functions import text as t
from tabularium.operators.geometry import cluster_anchored, dedupe_position, gathered_clusters, nearest_column
from tabularium.sources.publishers import as_load_lines

# Labels, distances and printed forms of each layout.
PAGE_HEIGHT = 2000.0
GRID_LABELS = {"Case:": "case_name", "Primer:": "primer", "Twist:": "twist"}
GRID_SPLIT_LABELS = {"Barrel": ("Length:", "barrel"), "Firearm": ("Used:", "test_firearm")}
GRID_NUMBER = r"^\*{0,2}(\d+(?:\.\d+)?)\*{0,2}$"
RECIPE_META = {
    "case_name": r"Max Case Length:\s*([\d.\"]+)",
    "coal_in": r"Max Cart\.? OAL:\s*([\d.\"]+)",
    "test_firearm": r"Test Firearm:\s*(.+)",
    "barrel": r"Barrel Length:\s*([\d.\"]+)",
}
SECTION_META = {
    "coal_in": r"(?i)\bCOAL:?\s*([\d.]+)",
    "case_name": r"(?i)\bCase:\s*(\S+)",
    "primer": r"(?i)Primer:\s*([A-Za-z0-9 .#-]+?)(?:\s{2,}|$)",
    "barrel": r"(?i)Barrel\s+Length:\s*([\d.\"]+)",
    "twist": r"(?i)Twist\s+Rate:\s*(\S+)",
}
SECTION_NUMBER = r"^\**(\d+(?:\.\d+)?)([a-zA-Z*]*)$"
SIDEBAR = (30.0, 160.0)
SIDEBAR_GRAIN = r"(?i)^(\d+)-?grain$"
SIDEBAR_STOP = ["Sectional", "Ballistic", "Density", "Coefficient", "C.O.A.L", "Suggested", "Bullet", "Use"]
SKU_WEIGHT = r"(?i)^(\d+)gr\.?$"
#: Heights of print that differ differ by this at least.
NEXT_TOP = 0.000001
RANGE_COLUMNS = ["charge_min", "velocity_min", "charge_max", "velocity_max"]


def _matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def _listed(when: Column, value: Column, *order: Column) -> Column:
    """Values of the rows where ``when`` holds, in order."""
    got = F.array_sort(F.collect_list(F.when(when, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))))
    return F.transform(got, lambda x: x["v"])


def _joined(when: Column, value: Column, *order: Column) -> Column:
    return F.array_join(_listed(when, value, *order), " ")


def _table_and_line_order(rows: DataFrame, table: list[str], line: list[str]) -> DataFrame:
    """Adds the place of each table in its document and of each line in its table."""
    tables = F.dense_rank().over(W.partitionBy("doc_id").orderBy(*table)) - 1
    lines = F.row_number().over(W.partitionBy("doc_id", *table).orderBy(*line)) - 1
    return rows.withColumns({"table_ord": tables, "line_ord": lines})


def _whole(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.array_join(_listed(F.lit(True), F.col("line"), F.col("line_no")), "\n").alias("whole"))


def _beside(rows: DataFrame, told: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """A join that sends neither side whole to every task: what is printed of few bytes is far more than planners think."""
    return rows.join(told.hint("merge"), keys, how)


def _document(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return _beside(rows, docs.select("doc_id", "cartridge", "item_name", "source_url"), "doc_id")


def _printed_rows(words: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Adds ``row``, the height of each word's row. All that follows is of one document, so words are dealt out by it once."""
    return cluster_anchored(words, keys, "top", tol, "row").repartition("doc_id")


def grid_specs(words: DataFrame) -> DataFrame:
    """The labelled values of page 0; a later label of one name wins. A page's words are gathered once and looked up there."""
    page = words.filter("page = 0 and x0 >= 0 and top is not null").groupBy("doc_id").agg(F.collect_list(F.struct("seq", "text", "x0", "top")).alias("at"))
    near = lambda a, b: F.abs(a["top"] - b["top"]) < 3.0
    mark = lambda seq, w: F.struct(seq.alias("seq"), w["x0"].alias("x0"), w["top"].alias("top"))
    by_word = lambda word: F.transform(F.filter("at", lambda w: w["text"] == word), lambda w: mark(w["seq"], w))

    def by_two(word: str, follows: str) -> Column:
        first = lambda a: F.array_min(F.transform(F.filter("at", lambda b: (b["text"] == follows) & near(a, b)), lambda b: F.struct(b["seq"], b["x0"].alias("x0"), b["top"].alias("top"))))
        return F.transform(F.filter("at", lambda w: w["text"] == word), lambda w: F.when(first(w).isNotNull(), mark(w["seq"], first(w))))

    marks = {name: by_word(word) for word, name in GRID_LABELS.items()} | {name: by_two(word, follows) for word, (follows, name) in GRID_SPLIT_LABELS.items()}
    page = page.withColumns({f"{n}_at": F.array_max(m) for n, m in marks.items()})

    def right(m: Column) -> Column:
        found = F.transform(F.filter("at", lambda w: near(w, m) & (w["x0"] > m["x0"])), lambda w: F.struct(w["x0"], w["seq"], w["text"].alias("v")))
        return F.when(m.isNotNull(), F.array_join(F.transform(F.array_sort(found), lambda x: x["v"]), " "))

    return page.select("doc_id", *[right(F.col(f"{n}_at")).alias(n) for n in marks])


def _variant(texts: Column) -> Column:
    """Weight and type of one row of the bullet list; empty without a weight."""
    hit = lambda x, i: F.when(_matches(x, r"^\d+gr\.?$"), F.struct(i.alias("at"), F.regexp_replace(x, r"\.$", "").alias("w"))).when(_matches(x, r"^\d+$") & (F.get(texts, i + 1) == "gr"), F.struct((i + 1).alias("at"), F.concat(x, F.lit("gr")).alias("w")))
    first = F.get(F.filter(F.transform(texts, hit), lambda x: x.isNotNull()), F.lit(0))
    kind = F.filter(F.slice(texts, first["at"] + 2, F.greatest(F.size(texts), F.lit(1))), lambda x: ~_matches(x, r'^[\d.]+"$'))
    return F.when(first.isNotNull(), F.concat_ws(" ", first["w"], F.nullif(F.array_join(kind, " "), F.lit("")))).otherwise("")


def from_grid_words(words: DataFrame, docs: DataFrame, source: str = "sierra", manufacturer: str = "Sierra") -> DataFrame:
    """Grid pages: velocities head the columns, charges stand under them, the fastest is the maximum."""
    page, by_page = ["doc_id", "page"], W.partitionBy("doc_id", "page")
    is_word = lambda x: F.col("text") == x
    at = words.filter("x0 >= 0 and page >= 1")
    at = at.withColumns({"ptop": F.min(F.when(is_word("Powder"), F.col("top"))).over(by_page), "btop": F.max(F.when(is_word("Bullet"), F.struct("seq", "top"))).over(by_page)["top"]})
    head = F.abs(F.col("top") - F.col("ptop")) < 3
    at = at.withColumns({"vx": F.min(F.when(is_word("Velocity") & head, F.struct("seq", "x0"))).over(by_page)["x0"], "etop": F.min(F.when(is_word("Energy") & (F.col("top") > F.col("ptop")), F.col("top"))).over(by_page)})
    column = F.when(head & _matches(F.col("text"), r"^\d+$") & (F.col("x0") > F.col("vx")), F.struct(F.col("x0").alias("x"), "seq", F.col("text").cast("double").alias("name")))
    at = at.withColumn("columns", F.array_sort(F.collect_list(column).over(by_page)))

    body = at.filter((F.size("columns") > 0) & (F.col("top") > F.col("ptop") + 5) & (F.col("top") < F.coalesce("etop", F.col("ptop") + 300)))
    body = body.withColumn("num", F.nullif(F.regexp_extract("text", GRID_NUMBER, 1), F.lit("")).cast("double"))
    body = body.withColumn("col", F.when(F.col("num").isNotNull(), nearest_column(F.col("x0"), F.col("columns"), 12.0)))
    rows = _printed_rows(body.select(*page, "seq", "text", "x0", "top", "num", "col"), page, 3.0)
    rows = rows.withColumn("left", F.min(F.when(F.col("col").isNotNull(), F.col("x0"))).over(W.partitionBy(*page, "row")))
    cells = F.array_sort(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", "x0", "top", "seq", "num"))))
    rows = rows.groupBy(*page, "row").agg(_joined(F.col("x0") < F.col("left") - 2, F.col("text"), F.col("x0"), F.col("top"), F.col("seq")).alias("powder"), cells.alias("cells")).filter("powder != ''")
    lines = rows.select(*page, "row", "powder", F.size("cells").alias("n"), F.posexplode("cells").alias("k", "cell"))

    bullets = at.filter(F.col("btop").isNotNull() & (F.col("top") > F.col("btop") + 5) & (F.col("top") < F.coalesce("ptop", F.col("btop") + 200))).select(*page, "seq", "text", "x0", "top")
    bullets = _printed_rows(bullets, page, 1.5).groupBy(*page, "row").agg(_listed(F.lit(True), F.col("text"), F.col("x0"), F.col("top"), F.col("seq")).alias("texts"))
    bullets = bullets.withColumn("d", _variant(F.col("texts"))).groupBy(*page).agg(t.joined_once(_listed(F.col("d") != "", F.col("d"), F.col("row")), " / ").alias("bullet_type"))

    out = _beside(_beside(_table_and_line_order(lines, ["page"], ["row", "k"]), bullets, page, "left"), grid_specs(words), "doc_id", "left")
    text = {n: F.coalesce(F.col(n), F.lit("")) for n in ("bullet_type", "case_name", "primer", "barrel", "twist", "test_firearm")}
    return as_load_lines(_document(out, docs), source=F.lit(source), manufacturer=F.lit(manufacturer), charge_gr=F.col("cell.num"), velocity_fps=F.col("cell.col"), is_max=F.col("k") == F.col("n") - 1, **text)


def _range_lines(rows: DataFrame, keys: list[str], order: list[str], in_name: Column, compressed: Column) -> DataFrame:
    """One line a printed row of words with ``num`` and ``col``: the last value of each column; three at least."""
    o = [F.col(c) for c in order]
    values = [F.max_by("num", F.when(F.col("col") == n, F.struct(*order))).alias(n) for n in RANGE_COLUMNS]
    out = rows.groupBy(*keys, "row").agg(_listed(in_name, F.col("text"), *o).alias("names"), F.count_if(compressed).alias("n_compressed"), *values)
    return out.filter((F.size("names") > 0) & (sum((F.col(n).isNotNull().cast("int") for n in RANGE_COLUMNS), F.lit(0)) >= 3))


def _gathered_ranges(clusters: Column, columns: Column, order: list[str], tol: float) -> Column:
    """As :func:`_range_lines`, of the clusters of a page's words with ``num``, ``in_name`` and ``squeezed``, by cluster.

    One expression, step by step, as planners copy what a later filter asks for into it.
    """
    at = lambda w: [w[o].alias(f"o{i}") for i, o in enumerate(order)]
    names = lambda ws: F.transform(F.sort_array(F.transform(F.filter(ws, lambda w: w["in_name"]), lambda w: F.struct(*at(w), w["text"].alias("v")))), lambda x: x["v"])
    nums = lambda ws: F.transform(F.filter(ws, lambda w: w["num"].isNotNull()), lambda w: F.struct(*at(w), w["num"].alias("v"), nearest_column(w["x0"], columns, tol).alias("col")))
    named = F.filter(clusters, lambda c: F.exists(c["items"], lambda w: F.coalesce(w["in_name"], F.lit(False))))
    told = F.transform(named, lambda c: F.struct(c["anchor"].alias("row"), names(c["items"]).alias("names"), nums(c["items"]).alias("nums"), F.size(F.filter(c["items"], lambda w: w["squeezed"])).alias("n_compressed")))
    value = lambda r, n: F.array_max(F.filter(r["nums"], lambda w: w["col"] == n))["v"].alias(n)
    valued = F.transform(told, lambda r: F.struct(r["row"].alias("row"), F.array_join(r["names"], " ").alias("powder"), r["n_compressed"].alias("n_compressed"), *[value(r, n) for n in RANGE_COLUMNS]))
    return F.filter(valued, lambda r: sum((r[n].isNotNull().cast("int") for n in RANGE_COLUMNS), F.lit(0)) >= 3)


def _as_ranges(rows: DataFrame, docs: DataFrame, source: str, manufacturer: str, flags: Column, **given: Column) -> DataFrame:
    ranges = {"charge_min_gr": F.col("charge_min"), "velocity_min_fps": F.col("velocity_min"), "charge_max_gr": F.col("charge_max"), "velocity_fps": F.col("velocity_max")}
    return as_load_lines(_document(rows, docs), source=F.lit(source), manufacturer=F.lit(manufacturer), is_max=F.lit(True), flags=flags, **ranges, **given)


def _range_columns(charges: Column, velocities: Column) -> Column:
    at = [F.get(charges, F.lit(0)), F.get(velocities, F.lit(0)), F.get(charges, F.lit(1)), F.get(velocities, F.lit(1))]
    return F.array(*[F.struct(x.alias("x"), F.lit(n).alias("name")) for x, n in zip(at, RANGE_COLUMNS)])


def from_recipe_words(words: DataFrame, lines: DataFrame, docs: DataFrame, source: str = "speer", manufacturer: str = "Speer") -> DataFrame:
    """Recipe pages of either template: one table a page at most, its notes the recipe's name.

    A page's words are gathered once, and all that is looked up on it is looked up there.
    """
    page, col = ["doc_id", "page"], F.col
    is_word = lambda w, *x: w["text"].isin(*x)
    marks = F.col("text").isin("Case", "Primer", "Grain", "Weight", "Velocity", "gr")
    word = F.struct("seq", "text", "x0", "top")
    at = words.groupBy(*page).agg(F.min(F.when(col("text") == "Propellant", F.struct("seq", "top", "x0"))).alias("head"), F.collect_list(F.when(marks, word)).alias("marks"), F.collect_list(word).alias("at"))
    at = at.filter("head is not null").select(*page, "marks", "at", col("head.top").alias("htop"), col("head.x0").alias("px"))
    near = lambda w: F.abs(w["top"] - col("htop")) < 15
    last = lambda x: F.array_max(F.transform(F.filter("marks", lambda w: near(w) & is_word(w, x)), lambda w: F.struct(w["seq"], w["x0"])))["x0"]
    every = lambda *x: F.sort_array(F.transform(F.filter("marks", lambda w: near(w) & is_word(w, *x) & w["x0"].isNotNull()), lambda w: w["x0"]))
    above = lambda x: F.array_min(F.transform(F.filter("marks", lambda w: (w["top"] < col("htop") - 10) & is_word(w, x)), lambda w: F.struct(w["seq"], w["top"])))["top"]
    at = at.select(*page, "at", "htop", "px", last("Case").alias("case_x"), last("Primer").alias("primer_x"), every("Grain", "Weight").alias("grains"), every("Velocity").alias("speeds"), above("gr").alias("gtop"), above("Weight").alias("wtop"))
    at = at.filter("case_x is not null and primer_x is not null and size(grains) >= 2 and size(speeds) >= 2").withColumn("columns", _range_columns(col("grains"), col("speeds")))

    value = lambda w: w["x0"] >= F.get("grains", F.lit(0)) - 20
    number = lambda w: F.when(value(w) & _matches(w["text"], r"^\d+(?:\.\d+)?$"), w["text"].cast("double"))
    body = F.transform(F.filter("at", lambda w: w["top"] > col("htop") + 5), lambda w: F.struct(*[w[c].alias(c) for c in ("seq", "text", "x0", "top")], number(w).alias("num"), (w["x0"] < (col("px") + col("case_x")) / 2).alias("in_name"), (value(w) & (F.upper(w["text"]) == "C")).alias("squeezed")))

    beside = lambda w, c: F.abs(w["top"] - col(c)) < 3
    said = lambda when, *order: F.transform(F.sort_array(F.transform(F.filter("at", when), lambda w: F.struct(*[w[o].alias(f"o{i}") for i, o in enumerate(order)], w["text"].alias("v")))), lambda x: x["v"])
    told = at.select(
        *page,
        "columns",
        "gtop",
        body.alias("body"),
        said(lambda w: beside(w, "gtop"), "x0", "seq").alias("row_texts"),
        F.get(said(lambda w: beside(w, "wtop") & _matches(w["text"], r"^\d+$"), "seq"), F.lit(0)).alias("legacy_weight"),
        F.array_join(said(lambda w: (w["top"] > col("wtop") - 60) & (w["top"] < col("wtop") - 3) & ~_matches(w["text"], r'^\.?\d+(\.\d+)?"?$'), "seq"), " ").alias("legacy_name"),
    )
    weighed = _matches(F.get("row_texts", F.lit(0)), r"^\d+$")
    skip = F.when(weighed & (F.get("row_texts", F.lit(1)) == "gr"), 2).when(weighed, 1).otherwise(0)
    rest = F.slice("row_texts", skip + 1, F.greatest(F.size("row_texts"), F.lit(1)))
    stop = F.get(F.filter(F.transform(rest, lambda x, i: F.when(_matches(x, r'^[\d.]+"?$'), i)), lambda i: i.isNotNull()), F.lit(0))
    name = F.array_join(F.slice(rest, F.lit(1), F.coalesce(stop, F.size(rest))), " ")
    told = told.select(*page, "columns", "body", F.when(col("gtop").isNotNull(), name).otherwise(col("legacy_name")).alias("bullet_type"), F.when(col("gtop").isNotNull(), F.when(weighed, F.get("row_texts", F.lit(0)))).otherwise(col("legacy_weight")).cast("double").alias("bullet_weight_gr"))

    ranges = _gathered_ranges(gathered_clusters(col("body"), "top", 2.0), col("columns"), ["x0", "top", "seq"], 16.0)
    found = told.select(*page, "bullet_type", "bullet_weight_gr", F.explode(ranges).alias("r")).select(*page, "bullet_type", "bullet_weight_gr", "r.*")

    meta = _whole(lines).select("doc_id", *[t.strip(t.first_group(col("whole"), p)).alias(n) for n, p in RECIPE_META.items()])
    out = _beside(_table_and_line_order(found, ["page"], ["row"]), meta, "doc_id", "left")
    text = {n: F.coalesce(col(n), F.lit("")) for n in ("bullet_type", "case_name", "barrel", "test_firearm")}
    return _as_ranges(out, docs, source, manufacturer, F.when(col("n_compressed") > 0, "compressed").otherwise(""), notes=col("item_name"), **text)


def _over(value: str, width: float) -> Column:
    """An aggregate over the words of a document so far above and below a word, and somewhat further: callers look at distances anew."""
    return F.expr(f"{value} over (partition by doc_id order by top range between {width + 0.5}D preceding and {width + 0.5}D following)")


def section_marks(words: DataFrame) -> DataFrame:
    """``doc_id, mark`` of every header and every trigger (what opens a bullet's section), in one sweep down the words.

    ``mark`` is ``form, seq, top, weight, kind, charges, velocities, block``; form 3 is a header, the others are triggers;
    ``block`` is where the next block of references begins. ``top`` counts on over pages. All that is looked up beside or
    around a word comes from frames over one order of the words, so they are dealt out and sorted once.
    """
    col, near = F.col, lambda x, width: F.abs(x["top"] - F.col("top")) < width
    texts = lambda found, *order: F.transform(F.array_sort(F.transform(found, lambda x: F.struct(*[x[o].alias(f"o{i}") for i, o in enumerate(order)], x["text"].alias("v")))), lambda x: x["v"])
    least = lambda found, *order: F.array_min(F.transform(found, lambda x: F.struct(*[x[o].alias(o) for o in order])))
    side = (col("x0") >= SIDEBAR[0]) & (col("x1") <= SIDEBAR[1])
    is_grain = lambda c: F.coalesce(_matches(c, SIDEBAR_GRAIN), F.lit(False))
    at = words.select("doc_id", "seq", "text", "x0", "top", F.coalesce(side, F.lit(False)).alias("side"))
    at = at.withColumns({"grain": col("side") & is_grain(col("text")), "sku": F.coalesce(_matches(col("text"), SKU_WEIGHT), F.lit(False)), "word": F.struct("top", "x0", "seq", "text")})
    # Words are gathered only beside those that ask for them.
    at = at.withColumns({"by_label": _over("max(text in ('Weight:', 'Style:'))", 3), "by_grain": _over("max(grain)", 14), "by_sku": _over("max(sku)", 10)})
    # All others are neither marks nor looked at by any.
    at = at.filter("by_label or (by_grain and side) or by_sku or text in ('Weight', 'Type', 'SKU', 'Powder', 'Charge', 'Velocity')")
    at = at.withColumns(
        {
            "line": _over("collect_list(if(by_label, word, null))", 3),
            "box": _over("collect_list(if(by_grain and side, word, null))", 14),
            "row": _over("collect_list(if(by_sku, word, null))", 10),
            "heads": _over("collect_list(if(text in ('Weight', 'Type'), word, null))", 3),
            "columns": _over("collect_list(if(text in ('Charge', 'Velocity'), word, null))", 20),
        }
    )
    right = F.filter("line", lambda x: near(x, 3.0) & (x["x0"] > col("x0")))
    at = at.withColumn("said", least(right, "x0", "seq", "text")["text"])
    named = lambda t: least(F.filter("heads", lambda x: near(x, 3.0) & (x["text"] == t)), "seq", "x0")["x0"]
    at = at.withColumn("head", F.when(col("text") == "SKU", F.struct("seq", "top", named("Weight").alias("wx"), named("Type").alias("tx"))))
    at = at.withColumns({"styles": _over("collect_list(if(text = 'Style:', struct(seq, top, said), null))", 20), "above": F.expr("collect_list(head) over (partition by doc_id order by top range between unbounded preceding and current row)")})

    mark = lambda form, weight, kind: F.struct(F.lit(form).alias("form"), "seq", "top", weight.alias("weight"), kind.alias("kind"), none.alias("charges"), none.alias("velocities"))
    none, number = F.lit(None).cast("array<double>"), F.lit(None).cast("double")
    bullet = F.exists("line", lambda x: near(x, 3.0) & (x["x0"] < col("x0")) & (x["text"] == "Bullet"))
    style = least(F.filter("styles", lambda x: near(x, 20.0) & (x["top"] > col("top"))), "seq", "said")["said"]
    lined = F.when((col("text") == "Weight:") & bullet, mark(0, F.nullif(F.regexp_extract("said", r"^([\d.]+)", 1), F.lit("")).try_cast("double"), F.coalesce(style, F.lit(""))))

    kept = lambda x: near(x, 14.0) & ~x["text"].isin(*SIDEBAR_STOP)
    same = F.filter("box", lambda x: kept(x) & near(x, 3.0) & (x["x0"] > col("x0")))
    wrap = F.filter("box", lambda x: kept(x) & (x["top"] - col("top") >= 3) & ~is_grain(x["text"]))
    boxed = F.when(col("grain"), mark(1, F.regexp_extract("text", SIDEBAR_GRAIN, 1).cast("double"), t.tidy(F.concat(texts(same, "x0", "seq"), texts(wrap, "x0", "seq")))))

    over = F.filter("above", lambda h: (h["top"] < col("top")) & (col("top") - h["top"] < 150.0) & (F.abs(col("x0") - h["wx"]) < 20))
    inside = lambda h: F.filter("row", lambda x: near(x, 10.0) & (x["x0"] >= h["tx"] - 10) & (x["x0"] < h["tx"] + 80))
    listed = F.when(col("sku"), F.transform(over, lambda h: mark(2, F.regexp_extract("text", SKU_WEIGHT, 1).cast("double"), F.array_join(texts(inside(h), "top", "x0", "seq"), " "))))

    xs = lambda name: F.array_sort(F.transform(F.filter("columns", lambda x: near(x, 20.0) & (x["text"] == name)), lambda x: x["x0"]))
    header = F.struct(F.lit(3).alias("form"), "seq", "top", number.alias("weight"), F.lit(None).cast("string").alias("kind"), xs("Charge").alias("charges"), xs("Velocity").alias("velocities"))
    header = F.when((col("text") == "Powder") & (F.size(xs("Charge")) >= 2) & (F.size(xs("Velocity")) >= 2), header)
    block = F.when(col("text") == "SKU", mark(4, number, F.lit(None).cast("string")))
    some = F.filter(F.array(lined, boxed, header, block), lambda m: m.isNotNull())
    found = at.select("doc_id", F.explode(F.concat(some, F.coalesce(listed, F.slice(some, F.lit(1), F.lit(0))))).alias("m")).select("doc_id", "m.*")
    later = F.expr(f"min(if(form = 4, top, null)) over (partition by doc_id order by top range between {NEXT_TOP}D following and unbounded following)")
    return found.withColumn("block", later).filter("form < 4").select("doc_id", F.struct("form", "seq", "top", "weight", "kind", "charges", "velocities", "block").alias("mark"))


def section_triggers(words: DataFrame) -> DataFrame:
    """``doc_id, trigger_id, top, weight, kind`` of every mark that opens a bullet's section. ``top`` counts on over pages."""
    found = section_marks(words).filter("mark.form < 3").select("doc_id", "mark.*")
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("top", "form", "seq")).cast("long")
    return found.withColumn("trigger_id", order).select("doc_id", "trigger_id", "top", "weight", "kind")


def from_section_words(words: DataFrame, lines: DataFrame, docs: DataFrame, source: str = "barnes", manufacturer: str = "Barnes") -> DataFrame:
    """Pages of several sections: every header takes its own trigger, its rows end at the next header or reference block."""
    from tabularium.operators.geometry import pair_exclusive

    col = F.col
    # One flow and one height over all pages of a document.
    flat = words.select("doc_id", (col("page").cast("long") * 1_000_000 + col("seq")).alias("seq"), "text", "x0", "x1", (col("top") + col("page") * PAGE_HEIGHT).alias("top"))
    # A mark without a height is no header, and opens no section.
    marks = section_marks(flat).filter("mark.top is not null").select("doc_id", "mark", F.coalesce("mark.top", F.lit(0.0)).alias("top"), (col("mark.form") == 3).cast("string").alias("role"))
    pairs = pair_exclusive(marks, "doc_id", "top", "mark", "role", "true", "false", rows_each=None)
    h = lambda name: col(f"header_id.{name}")
    end = F.lead(h("top")).over(W.partitionBy("doc_id").orderBy(h("top"), h("seq")))
    far = F.lit(float("inf"))
    heads = pairs.select(
        "doc_id",
        h("seq").alias("header_id"),
        h("top").alias("htop"),
        _range_columns(h("charges"), h("velocities")).alias("columns"),
        col("trigger_id.weight").alias("weight"),
        col("trigger_id.kind").alias("kind"),
        F.least(F.coalesce(end, far), F.coalesce(h("block"), far)).alias("hi"),
        (F.least(F.coalesce("trigger_id.top", h("top")), h("top")) - 5).alias("lo"),
    )
    spans = heads.groupBy("doc_id").agg(F.collect_list(F.struct("header_id", "htop", "lo", "hi", "columns", "weight", "kind")).alias("spans"))
    placed = _beside(flat, spans, "doc_id").withColumn("s", F.explode(F.filter("spans", lambda s: (col("top") > s["lo"]) & (col("top") < s["hi"])))).drop("spans")
    keys, told, own = ["doc_id", "header_id"], ["htop", "weight", "kind"], {n: f"own_{n}" for n in SECTION_META}
    got = lambda c, p: F.nullif(t.strip(t.first_group(F.col(c), p)), F.lit(""))
    # What a section says is read off the same gathering of its words that its rows are taken from.
    num = F.nullif(F.regexp_extract("text", SECTION_NUMBER, 1), F.lit("")).cast("double")
    word = F.when(col("top") > col("s.htop") + 5, F.struct("seq", "text", "x0", "top", num.alias("num"), F.when(num.isNotNull(), nearest_column(col("x0"), col("s.columns"), 15.0)).alias("col")))
    sections = placed.groupBy("doc_id", "s.header_id", *[f"s.{n}" for n in told]).agg(_joined(F.lit(True), col("text"), col("seq")).alias("here"), F.collect_list(word).alias("body"))
    sections = sections.select(*keys, *told, *[got("here", p).alias(own[n]) for n, p in SECTION_META.items()], "body")
    rows = _printed_rows(sections.withColumn("w", F.explode("body")).select(*keys, *told, *own.values(), "w.*"), keys, 1.2)
    rows = dedupe_position(rows, [*keys, "row"], col("x0"), col("top"), col("text"), ["x0", "top", "seq"])
    rows = rows.withColumn("left", F.min(F.when(col("col").isNotNull(), col("x0"))).over(W.partitionBy(*keys, "row")))
    squeezed = col("col").isNotNull() & F.contains(F.lower(F.regexp_extract("text", SECTION_NUMBER, 2)), F.lit("c"))
    found = _range_lines(rows, [*keys, *told, *own.values()], ["x0", "top", "seq"], col("x0") < col("left") - 2, squeezed)
    found = found.filter("(charge_min is null or charge_max is null or charge_max > charge_min) and (velocity_min is null or velocity_max is null or velocity_max > velocity_min)")
    found = found.withColumn("name", F.array_join(F.filter("names", lambda n: ~_matches(n, "^[A-Za-z0-9]$")), " "))
    found = _beside(_table_and_line_order(found, ["htop", "header_id"], ["row"]), _whole(lines), "doc_id", "left")
    meta = {n: F.coalesce(own[n], got("whole", p), F.lit(None if n == "coal_in" else "")) for n, p in SECTION_META.items()}
    flags = F.array_join(F.concat(F.when(col("name").startswith("*"), F.array(F.lit("most accurate"))).otherwise(F.array().cast("array<string>")), F.array_repeat(F.lit("compressed"), col("n_compressed").cast("int"))), ", ")
    powder = t.strip(F.regexp_replace("name", r"^\*+", ""))
    return _as_ranges(found, docs, source, manufacturer, flags, powder=powder, bullet_weight_gr=col("weight"), bullet_type=F.coalesce("kind", F.lit("")), **meta)
