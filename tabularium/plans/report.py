"""One lookup as text for a terminal and as a page that needs nothing else.

Only the lines of one query's documents are brought to the driver; they are formatted by Spark and put in order there.
"""

from __future__ import annotations

import os
import re
from datetime import datetime
from html import escape
from itertools import groupby

from pyspark.sql import Row
from pyspark.sql import functions as F

from tabularium.functions import text as t
from tabularium.plans.lookup import Lookup

TINTS = {"Nosler": "#803", "Sierra": "#850", "Speer": "#058", "Hammer Bullets": "#508", "Barnes": "#063"}
STYLE = "body{font:15px/1.4 sans-serif;max-width:60em;margin:auto;padding:1em}section{border-left:4px solid var(--tint,#555);padding-left:1em}table{border-collapse:collapse;width:100%}td,th{text-align:left;padding:2px 8px;border-bottom:1px solid #ddd}.max{font-weight:bold}.empty-link{opacity:.5}.amber{background:#fd8}.green{background:#bea}.plain{background:#eee}nav a{margin-right:1em}@media print{nav{display:none}}"
WARNING = "These figures are the publishers' own, gathered and laid out anew, and nobody has checked them here. Compare with the publisher's current data before use, begin at the starting charge, watch for signs of pressure while working up, and never go beyond a published maximum."
SPECS = (("Case", "case_name"), ("Primer", "primer"), ("Barrel", "barrel"), ("Twist", "twist"), ("COAL", "coal_in"), ("Test firearm", "test_firearm"))


def fetched(found: Lookup) -> tuple[list[Row], dict[str, list[Row]]]:
    """Rows of all sources in the order asked, and each source's lines in order with their shown forms."""
    shown = found.lines.withColumns(
        {
            "charge": t.charge_display(F.col("charge_gr"), F.col("charge_min_gr"), F.col("charge_max_gr"), F.col("is_max")),
            "velocity": t.velocity_display(F.col("velocity_fps"), F.col("velocity_min_fps")),
            "weight": F.when(F.col("bullet_weight_gr") != 0, t.display_g(F.col("bullet_weight_gr"))),
            "badges": t.badges(F.col("flags")),
        }
    )
    lines: dict[str, list[Row]] = {}
    for r in shown.orderBy("source", "doc_id", "table_ord", "line_ord").collect():
        lines.setdefault(r["source"], []).append(r)
    return found.results.orderBy("pos").collect(), lines


def _tables(lines: list[Row]):
    return ((rows[0], rows) for rows in (list(g) for _, g in groupby(lines, key=lambda r: (r["doc_id"], r["table_ord"]))))


def as_text(results: list[Row], lines: dict[str, list[Row]]) -> str:
    out: list[str] = []
    for s in results:
        out += ["", f"=== {s['manufacturer']} ==="]
        out += [f"matched cartridge: {s['matched']}"] * (s["matched"] is not None) + [f"  ! {e}" for e in s["errors"]]
        for head, rows in _tables(lines.get(s["source"], [])):
            weight = f", {head['weight']}gr" if head["weight"] else ""
            out += ["", f"{head['manufacturer']} — {head['cartridge']}{weight}{' ' if head['bullet_type'] else ''}{head['bullet_type']}"]
            out += [f"  source: {head['source_url']}"] * bool(head["source_url"])
            out += ["  ".join([f"    {r['powder']:<20}", r["charge"], r["velocity"], *([f"[{r['flags']}]"] if r["flags"] else [])]) for r in rows]
    return "\n".join([*out, ""])


def slug(text: str) -> str:
    return "-".join(re.findall("[a-z0-9]+", text.lower())) or "query"


def _table_html(head: Row, rows: list[Row]) -> str:
    title = " ".join([f"{head['weight']} gr"] * bool(head["weight"]) + [escape(head["bullet_type"])] * bool(head["bullet_type"])) or "&nbsp;"
    specs = " · ".join(f"{k}: {escape(head[c])}" for k, c in SPECS if head[c])
    link = f'<a href="{escape(head["source_url"])}">source</a>' if head["source_url"] else ""
    note = f"<p>{escape(head['notes'])}</p>" if head["notes"] else ""
    marks = lambda r: " ".join(f'<span class="{b["kind"]}">{escape(b["text"])}</span>' for b in r["badges"])
    body = "".join(f'<tr><td>{escape(r["powder"])}<td{" class=max" if r["is_max"] else ""}>{escape(r["charge"])}<td>{escape(r["velocity"])}<td>{marks(r)}' for r in rows)
    return f"<h3>{title} {link}</h3><p>{specs}</p>{note}<table><tr><th>Powder<th>Charge<th>Velocity<th>Flags{body}</table>"


def as_html(query: str, results: list[Row], lines: dict[str, list[Row]], now: datetime) -> str:
    nav, sections = [], []
    for s in results:
        mine, name = lines.get(s["source"], []), escape(s["manufacturer"])
        nav.append(f'<a href="#{slug(s["manufacturer"])}"{"" if mine else " class=empty-link"}>{name} {len(mine)}</a>')
        why = escape("; ".join(s["errors"]))
        if mine:
            inner = f"<p>{escape(s['matched'] or query)}</p>" + (f"<p>{why}</p>" if why else "") + "".join(_table_html(h, r) for h, r in _tables(mine))
        else:
            inner = f"<p>No data — {why or 'no data returned'}.</p>"
        sections.append(f'<section id="{slug(s["manufacturer"])}" style="--tint:{TINTS.get(s["manufacturer"], "#555")}"><h2>{name}</h2>{inner}</section>')
    total, filled = sum(map(len, lines.values())), sum(bool(lines.get(s["source"])) for s in results)
    head = f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{escape(query)}</title><style>{STYLE}</style>'
    return f"{head}<h1>{escape(query)}</h1><p>{now:%Y-%m-%d %H:%M} · {total} lines from {filled} sources</p><nav>{''.join(nav)}</nav>{''.join(sections)}<footer>{WARNING}</footer></html>\n"


def write_report(query: str, results: list[Row], lines: dict[str, list[Row]], folder: str = "reports", now: datetime | None = None) -> str:
    """Path of the page written."""
    now = now or datetime.now()
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{slug(query)}-{now:%Y%m%d-%H%M%S}.html")
    with open(path, "w", encoding="utf-8") as f:
        f.write(as_html(query, results, lines, now))
    return path
