"""Every query of the engine's own operators over ordinary tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabularium.functions import match
from tabularium.functions import text as t
from tabularium.operators import geometry, sequence
from tabularium.operators.pieces import dealt
from tabularium.sources import listings, publishers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of orders that one task sorts and counts, some 300 bytes each.
LINES_EACH = 500_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds."""
    return read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


_PAIRS = ", ".join(f"'{k}': '{v}'" for k, v in t.ABBREVIATIONS.items())
_EXPAND = f"flatten(list_transform(regexp_extract_all(lower(replace({{0}}, '×', 'x')), '[a-z0-9]+'), lambda w: string_split(coalesce(map {{{{{_PAIRS}}}}}[w], w), ' ')))"
_ZERO = "case when regexp_full_match({0}, '0+') then '0' else regexp_replace({0}, '^0+', '') end"
_JOINED = "regexp_replace({0}, '\\bs\\s*&\\s*w\\b', 'sw', 'gi')"


def _raw_sql(x: str) -> str:
    return f"list_transform({_EXPAND.format(x)}, lambda v: {_ZERO.format('v')})"


def _normal_sql(x: str) -> str:
    bare = "regexp_replace(v, '([0-9])mm$', '\\1')"
    return f"list_sort(list_transform({_EXPAND.format(_JOINED.format(x))}, lambda v: {_ZERO.format(bare)}))"


@query(f"select name, array_to_string({_normal_sql('name')}, ' ') as key from (select distinct c_name as name from customer union select distinct p_brand from part union select distinct p_name from part)")
def fuzzy_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal names of customers, brands and parts."""
    part, customer = read(spark, sf_dir, "part"), read(spark, sf_dir, "customer")
    names = customer.select(F.col("c_name").alias("name")).union(part.select("p_brand")).union(part.select("p_name")).distinct()
    return names.select("name", t.normalize(F.col("name")).alias("key"))


_PHRASES = ("small ring", "ring", "small", "brand 19", "Brand#23", "polished", "small ring small", "45")
_ASKED_SQL = f"select i - 1 as query_id, [{', '.join(f"'{p}'" for p in _PHRASES)}][i] as text from range(1, {len(_PHRASES) + 1}) r(i)"
_LISTED_SQL = "select 'name' as source, p_name as label, min(p_partkey) as ord from part group by all union all select 'brand', p_brand, min(p_partkey) from part group by all"


def _score_sql(asked: str, listed: str) -> str:
    """The product of queries and labels, scored by tokens; the five best of each source."""
    return f"""
with q as ({asked}), c as ({listed}),
a as (select query_id, text, {_normal_sql('text')} as qn, {_raw_sql('text')} as qr from q), b as (select source, ord, label, {_normal_sql('label')} as cn, {_raw_sql('label')} as cr from c),
y as (select *, list_filter(list_distinct(qn), lambda v: not list_contains(cn, v)) as missing,
             case when len(qn) > 0 and len(list_filter(qn, lambda v: not list_contains(cn, v))) = 0 then 0.75::double + 0.25::double * len(list_distinct(qn)) / greatest(len(list_distinct(cn)), 1) else 0::double end as base from a, b),
z as (select query_id, source, ord, label, cast(case when array_to_string(qn, ' ') = array_to_string(cn, ' ') then 1
             when len(list_filter(missing, lambda v: regexp_full_match(v, '[0-9]+'))) > 0 then 0
             when len(qr) > 0 and cr[1:len(qr)] = qr then least(0.95::double, base + 0.3::double) else base end as double) as score from y),
r as (select *, row_number() over (partition by query_id, source order by score desc, ord) as rank from z)
select query_id, source, ord, label, round(score, 9) as score, rank from r where rank <= 5 and score >= 0.45"""


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    one = lambda s, c: part.groupBy(F.col(c).alias("label")).agg(F.min("p_partkey").alias("ord")).select(F.lit(s).alias("source"), "ord", "label")
    return one("name", "p_name").unionByName(one("brand", "p_brand"))


def _phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(_PHRASES)], "query_id bigint, text string")


@query(_score_sql(_ASKED_SQL, _LISTED_SQL))
def fuzzy_topk_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best labels for phrases, by token sets alone."""
    found = match.best_matches(_phrases(spark), _catalogue(spark, sf_dir), use_ratio=False)
    return found.select("query_id", "source", "ord", "label", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    _score_sql(
        "select 'first ' || min(p_partkey) as query_id, split_part(p_name, ' ', 1) || ' ' || p_brand as text from part group by 2 union all select 'name ' || min(p_partkey), p_name from part group by 2",
        "select p_type as source, p_name || ' ' || p_brand || ' ' || p_size as label, min(p_partkey) as ord from part group by all",
    )
)
def fuzzy_topk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best parts of each type for every first word and brand, and for every name; labels are found by an index of their tokens."""
    part = read(spark, sf_dir, "part")
    told = lambda name, text: part.groupBy(text.alias("text")).agg(F.concat(F.lit(name), F.min("p_partkey")).alias("query_id")).select("query_id", "text")
    asked = told("first ", F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand")).unionByName(told("name ", F.col("p_name")))
    listed = part.groupBy(F.col("p_type").alias("source"), F.concat_ws(" ", "p_name", "p_brand", "p_size").alias("label")).agg(F.min("p_partkey").alias("ord"))
    found = match.best_matches(asked, listed, use_ratio=False)
    return found.select("query_id", "source", "ord", "label", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


#: The longest common block of two ranges, the leftmost of equals; ranges to either side of it follow in the recursion.
_BLOCK_SQL = """list_max(flatten(list_transform(range(a_from, a_to), lambda i: list_transform(range(b_from, b_to), lambda j: {
  'n': coalesce(list_max(list_filter(range(1, least(a_to - i, b_to - j) + 1), lambda n: substr(a, i, n) = substr(b, j, n))), 0), 'i': -i, 'j': -j}))))"""
_RATIO_SQL = f"""
with recursive q as (select i - 1 as query_id, [{', '.join(f"'{p}'" for p in _PHRASES)}][i] as text from range(1, {len(_PHRASES) + 1}) r(i)),
c as (select 'name' as source, p_name as label, min(p_partkey) as ord from part group by all union all select 'brand', p_brand, min(p_partkey) from part group by all),
x as (select query_id, source, ord, label, {_normal_sql('text')} as qn, {_raw_sql('text')} as qr, {_normal_sql('label')} as cn, {_raw_sql('label')} as cr from q, c),
w as (select distinct array_to_string(qn, ' ') as a, array_to_string(cn, ' ') as b from x),
m as (select a, b, a_from, a_to, b_from, b_to, {_BLOCK_SQL} as m from (select a, b, 1::bigint as a_from, len(a) + 1 as a_to, 1::bigint as b_from, len(b) + 1 as b_to from w)
      union all
      select a, b, a_from, a_to, b_from, b_to, {_BLOCK_SQL} from (
        select a, b, p.a_from as a_from, p.a_to as a_to, p.b_from as b_from, p.b_to as b_to from (
          select a, b, unnest([{{'a_from': a_from, 'a_to': -m.i, 'b_from': b_from, 'b_to': -m.j}}, {{'a_from': m.n - m.i, 'a_to': a_to, 'b_from': m.n - m.j, 'b_to': b_to}}]) as p from m where m.n > 0)
        where p.a_from < p.a_to and p.b_from < p.b_to)),
t as (select a, b, 2.0::double * sum(m.n) / (len(a) + len(b)) as ratio from m group by a, b),
y as (select x.*, ratio, list_filter(list_distinct(qn), lambda v: not list_contains(cn, v)) as missing,
             case when len(qn) > 0 and len(list_filter(qn, lambda v: not list_contains(cn, v))) = 0 then 0.75::double + 0.25::double * len(list_distinct(qn)) / greatest(len(list_distinct(cn)), 1)
                  when ratio >= 0.75 then ratio else 0::double end as base
      from x join t on t.a = array_to_string(qn, ' ') and t.b = array_to_string(cn, ' ')),
z as (select query_id, source, ord, label, cast(case when array_to_string(qn, ' ') = array_to_string(cn, ' ') then 1
             when len(list_filter(missing, lambda v: regexp_full_match(v, '[0-9]+'))) > 0 then 0
             when len(qr) > 0 and cr[1:len(qr)] = qr then least(0.95::double, base + 0.3::double) else base end as double) as score from y),
r as (select *, row_number() over (partition by query_id, source order by score desc, ord) as rank from z)
select query_id, source, ord, label, round(score, 9) as score, rank from r where rank <= 20 and score >= 0.45"""


@query(_RATIO_SQL)
def fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best labels for phrases, character ratio included."""
    found = match.best_matches(_phrases(spark), _catalogue(spark, sf_dir), limit=20)
    return found.select("query_id", "source", "ord", "label", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def _anchors_sql(key: str, width: int) -> str:
    return f"""
with recursive e as (select {key} as k, epoch_us(ts) as us, event_id from events),
a as (select k, min(us) as anchor from e group by k
      union all select a.k, (select min(us) from e where e.k = a.k and us - a.anchor > {width}) from a
      where exists (select 1 from e where e.k = a.k and us - a.anchor > {width})),
b as (select e.k, max(a.anchor) as anchor from e join a on a.k = e.k and a.anchor <= e.us group by e.k, e.event_id)
select k as user_id, anchor, count(*) as n from b group by all"""


@query(_anchors_sql("user_id", 86_400_000_000))
def cluster_rows_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in clusters of a day from their first."""
    e = events(spark, sf_dir).select("user_id", "us")
    return geometry.cluster_anchored(e, ["user_id"], "us", 86_400_000_000, split=True).groupBy("user_id", "anchor").agg(F.count(F.lit(1)).alias("n"))


@query(_anchors_sql("user_id % 2", 7_200_000_000))
def cluster_rows_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of half of the users in clusters of two hours, without a gap: each key's order is cut into pieces."""
    e = events(spark, sf_dir).select((F.col("user_id") % 2).alias("user_id"), "us")
    return geometry.cluster_anchored(e, ["user_id"], "us", 7_200_000_000, split=True, rows_each=1000).groupBy("user_id", "anchor").agg(F.count(F.lit(1)).alias("n"))


_REFS = ((5.0, "low"), (15.0, "mid"), (25.0, "high"), (40.0, "top"))


@query(f"""
with r as (select unnest([{', '.join(f"{{'x': {x}, 'i': {i}, 'name': '{n}'}}" for i, (x, n) in enumerate(_REFS))}], recursive := true)),
l as (select l_quantity, l_extendedprice from lineitem),
d as (select distinct l_quantity as q from l),
m as (select q, arg_min(name, (abs(x - q), i)) as name, min(abs(x - q)) as dist from d, r group by q)
select name as col, count(*) as n, round(sum(l_extendedprice), 2) as total from l join m on q = l_quantity where dist <= 3 group by name""")
def nearest_column_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities to the nearest of four columns within a tolerance."""
    cols = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(n).alias("name")) for x, n in _REFS])
    rows = read(spark, sf_dir, "lineitem").select("l_extendedprice", geometry.nearest_column(F.col("l_quantity"), cols, 3.0).alias("col"))
    return rows.filter("col is not null").groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""
with r as (select *, row_number() over (partition by l_orderkey order by l_discount desc, l_quantity desc, l_partkey desc, l_suppkey desc, l_linenumber desc) = 1 as is_max from lineitem)
select l_orderkey, l_partkey, l_discount as velocity, l_quantity as charge, is_max, count(*) as n from r group by all""")
def grid_unpivot_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of an order's grid as rows, the highest column marked."""
    order = [F.desc(c) for c in ("l_discount", "l_quantity", "l_partkey", "l_suppkey", "l_linenumber")]
    lines = read(spark, sf_dir, "lineitem")
    rows = dealt(lines, ["l_orderkey"], lines.count(), LINES_EACH).withColumn("is_max", sequence.last_in_group(["l_orderkey"], order))
    return rows.groupBy("l_orderkey", "l_partkey", F.col("l_discount").alias("velocity"), F.col("l_quantity").alias("charge"), "is_max").agg(F.count(F.lit(1)).alias("n"))


@query("""
with c as (select l_orderkey, l_linenumber, max(l_quantity) as v from lineitem where l_linenumber <= 4 group by all),
p as (select l_orderkey, max(v) filter (l_linenumber = 1) as a, max(v) filter (l_linenumber = 2) as b, max(v) filter (l_linenumber = 3) as c, max(v) filter (l_linenumber = 4) as d from c group by l_orderkey)
select * from p where (a is not null)::int + (b is not null)::int + (c is not null)::int + (d is not null)::int >= 3 and (a is null or c is null or c > a) and (b is null or d is null or d > b)""")
def pivot4_valid3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four named cells a row, of which three must be there and rise."""
    cells = read(spark, sf_dir, "lineitem").filter("l_linenumber <= 4").select("l_orderkey", F.element_at(F.array(*map(F.lit, "abcd")), F.col("l_linenumber")).alias("cell"), F.col("l_quantity").alias("v"))
    wide = geometry.pivot4(cells, ["l_orderkey"], "cell", F.col("v"), ["v"], list("abcd"))
    return wide.filter("n_cells >= 3 and (a is null or c is null or c > a) and (b is null or d is null or d > b)").drop("n_cells")


@query("""
with r as (select *, row_number() over (partition by l_suppkey, floor(l_quantity), floor(l_extendedprice / 5000) order by contains(l_shipdate::varchar, '15') desc, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as n,
           count(*) over (partition by l_suppkey, floor(l_quantity), floor(l_extendedprice / 5000)) as copies from lineitem)
select l_suppkey, l_orderkey, l_partkey, l_quantity, copies from r where n = 1""")
def dedupe_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a position, the one that a mark makes better."""
    rows = read(spark, sf_dir, "lineitem").withColumns({"x": F.floor("l_quantity").cast("double"), "y": F.floor(F.col("l_extendedprice") / 5000).cast("double")})
    rows = rows.withColumn("copies", F.count(F.lit(1)).over(W.partitionBy("l_suppkey", "x", "y")))
    mark = F.when(F.contains(F.col("l_shipdate").cast("string"), F.lit("15")), ".").otherwise("")
    kept = geometry.dedupe_position(rows, ["l_suppkey"], F.col("x"), F.col("y"), mark, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return kept.select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity", "copies")


def _pairs_sql(key: str) -> str:
    """Row by row: a stack of unused triggers, or a header that waits."""
    return f"""
with recursive e as (select {key} as user_id, event_id, event_type = 'signup' as below, row_number() over (partition by {key} order by epoch_us(ts), event_type = 'signup', event_id) as k from events where event_type in ('error', 'signup')),
s as (select user_id, 0::bigint as k, []::bigint[] as unused, null::bigint as waiting, null::bigint as header_id, null::bigint as trigger_id from e where k = 1
      union all
      select e.user_id, e.k,
             case when below and waiting is null then list_append(unused, event_id::bigint) when not below and len(unused) > 0 then unused[:len(unused) - 1] else unused end,
             case when not below and len(unused) = 0 then event_id end,
             case when below or waiting is not null then waiting when len(unused) > 0 then event_id end,
             case when below and waiting is not null then event_id when not below and waiting is null and len(unused) > 0 then unused[len(unused)] end
      from s join e on e.user_id = s.user_id and e.k = s.k + 1)
select user_id, header_id, trigger_id from s where header_id is not null
union all
select user_id, waiting, null from s where waiting is not null and k = (select max(k) from e where e.user_id = s.user_id)"""


@query(_pairs_sql("user_id"))
def asof_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user, each with the sign-up it takes."""
    return geometry.pair_exclusive(events(spark, sf_dir), "user_id", "us", "event_id", "event_type", "error", "signup")


@query(_pairs_sql("user_id % 2"))
def asof_exclusive_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of half of the users, each with the sign-up it takes; each key's order is cut into pieces."""
    e = events(spark, sf_dir).withColumn("user_id", F.col("user_id") % 2)
    return geometry.pair_exclusive(e, "user_id", "us", "event_id", "event_type", "error", "signup", rows_each=500)


@query("""
select event_id, user_id, min(case when event_type = 'error' then epoch_us(ts) end) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as boundary from events""")
def next_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next error of the user after each event."""
    out = geometry.next_boundary(events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("us"), F.col("event_type") == "error")
    return out.select("event_id", "user_id", "boundary")


@query("""
select a.event_id as event_id_l, b.event_id as event_id_r from events a join events b
on a.user_id = b.user_id and a.event_id < b.event_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) < 600000000""")
def same_line_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user less than ten minutes apart."""
    e = events(spark, sf_dir).select("user_id", "event_id", "us")
    return geometry.band_pairs(e, e, ["user_id"], "us", 600_000_000).filter("event_id_l < event_id_r").select("event_id_l", "event_id_r")


@query("""
select * from (select event_id, user_id, last_value(case when event_type = 'purchase' and value > 50 then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as carried from events) where carried is not null""")
def forward_fill_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last large purchase, carried forward."""
    large = (F.col("event_type") == "purchase") & (F.col("value") > 50)
    return sequence.forward_fill_if(events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("event_id"), large, "carried").select("event_id", "user_id", "carried")


@query("""
with k as (select *, case event_type when 'signup' then 'META' when 'click' then 'BULLET' when 'purchase' then 'HEADER' when 'view' then 'DATA' end as kind from events where event_type <> 'error'),
a as (select *, coalesce(sum((kind in ('META', 'HEADER'))::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as seg,
         sum((kind = 'HEADER')::int) over u as table_id,
         last_value(case when kind in ('META', 'HEADER') then kind end ignore nulls) over u as active,
         last_value(case when kind = 'META' then event_id end ignore nulls) over u as meta
      from k window u as (partition by user_id order by event_id rows between unbounded preceding and current row)),
b as (select *, first_value(case when kind = 'BULLET' then event_id end ignore nulls) over (partition by user_id, seg order by event_id rows between unbounded preceding and current row) as first_item from a),
c as (select *, max(case when kind = 'HEADER' then first_item end) over (partition by user_id, table_id) as item from b)
select event_id, user_id, cast(table_id as bigint) as table_id, item, meta from c where kind = 'DATA' and active = 'HEADER'""")
def sheet_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a printed sheet: data rows with their table, item and heading."""
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "META", "click", "BULLET", "purchase", "HEADER", "view", "DATA")])
    e = events(spark, sf_dir).filter("event_type != 'error'")
    out = sequence.sheet_islands(e, ["user_id"], "event_id", F.try_element_at(kinds, F.col("event_type")), F.col("event_id"), F.col("event_id"))
    return out.select("event_id", "user_id", F.col("table_id").cast("long").alias("table_id"), "item", "meta")


#: The pages of the tables have links of one form, without tags inside: cut at that form, no tags are read.
_PLAIN_TEXT = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;', '&')"
_ANCHOR_SQL = f"""
a as (select page_id, unnest(string_split(html, '<a href="')[2:]) as x, unnest(range(len(string_split(html, '<a href="')) - 1)) as ord from pages),
n as (select page_id, ord, {_PLAIN_TEXT.format("split_part(x, '\">', 1)")} as href, trim({_PLAIN_TEXT.format("split_part(substr(x, strpos(x, '\">') + 2), '</a>', 1)")}) as label from a)"""


@query(f"with {_ANCHOR_SQL} select page_id, cast(ord as integer) as ord, label, case when starts_with(href, 'http') then href else 'https://example.org' || href end as url from n where label <> '' and contains(lower(href), 'th')")
def html_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page that a rule keeps, made absolute."""
    found = listings.anchors(read(spark, sf_dir, "pages").select("page_id", "html"))
    kept = found.filter((F.col("label") != "") & F.contains(F.lower("href"), F.lit("th")))
    return kept.select("page_id", "ord", "label", t.absolute(F.col("href"), "https://example.org").alias("url"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of an embedded object, with text after it."""
    e = read(spark, sf_dir, "events")
    html = F.concat(F.lit("<script>var recipeJson = "), F.col("props"), F.lit("; var x = 1;</script>"))
    return e.select("event_id", listings.embedded_json(html, schema="k bigint")["k"].alias("k"))


@query(f"""
with {_ANCHOR_SQL},
u as (select 0 as src, page_id as a, ord as b, label, href as name from n where label <> '' union all select 1, p_partkey, 0, p_name, p_brand from part),
k as (select *, array_to_string({_normal_sql('label')}, ' ') as key from u)
select key, arg_min(label, (src, a, b, name)) as label, count(*) as n_recipes, md5(string_agg(name, '|' order by src, a, b, name)) as recipes from k group by key""")
def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and part names under one normal name each, all recipes kept in order."""
    found = listings.anchors(read(spark, sf_dir, "pages").select("page_id", "html")).filter("label != ''")
    links = found.select(F.lit(0).alias("src"), F.col("page_id").alias("a"), F.col("ord").alias("b"), "label", F.col("href").alias("name"))
    parts = read(spark, sf_dir, "part").select(F.lit(1).alias("src"), F.col("p_partkey").alias("a"), F.lit(0).alias("b"), F.col("p_name").alias("label"), F.col("p_brand").alias("name"))
    merged = listings.merge_catalogue(links.unionByName(parts).withColumn("pdf_url", F.lit("")), ["src", "a", "b", "name"])
    return merged.select("key", "label", F.size("recipes").cast("long").alias("n_recipes"), F.md5(F.array_join(F.transform("recipes", lambda r: r["name"]), "|").cast("binary")).alias("recipes"))


_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


@query(f"""
with s as (select doc_id, regexp_split_to_array(text, '{_BREAKS}') as p from documents),
l as (select doc_id, unnest(case when p[len(p)] = '' then p[:len(p) - 1] else p end) as line from s)
select doc_id, count(*) as n_lines, cast(sum(length(line)) as bigint) as chars, cast(count(*) filter (regexp_matches(line, '(token|secret) [=:]')) as bigint) as marked from l group by doc_id""")
def line_split_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every text, the end of the last one off, and those that a pattern marks."""
    lines = publishers.text_lines(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"), F.count(F.when(F.rlike("line", F.lit("(token|secret) [=:]")), 1)).alias("marked"))


@query("select l_quantity as q, printf('%g', l_quantity) as q_text, l_discount as d, printf('%g', l_discount) as d_text, printf('%g', l_quantity * 7531) as wide, printf('%g', l_discount * l_quantity / 70000) as fine, count(*) as n from lineitem group by all")
def display_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as a reader writes them, small and large ones as powers of ten."""
    q, d = F.col("q"), F.col("d")
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("q", t.display_g(q).alias("q_text"), "d", t.display_g(d).alias("d_text"), t.display_g(q * 7531).alias("wide"), t.display_g(d * q / 70000).alias("fine"), "n")


@query("""
select p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'query') as slug,
replace(replace(replace(replace(replace('<' || p_name || '> & "' || p_brand || '"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped from part""")
def slug_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and escaped text."""
    both = F.concat(F.lit("<"), F.col("p_name"), F.lit('> & "'), F.col("p_brand"), F.lit('"'))
    return read(spark, sf_dir, "part").select("p_partkey", t.slug(F.concat("p_name", F.lit(" & "), "p_brand")).alias("slug"), t.escape_html(both).alias("escaped"))


@query("select event_id, user_id, epoch_us(timestamp '2024-01-20 00:00:00') - epoch_us(ts) as age_us from events where epoch_us(timestamp '2024-01-20 00:00:00') - epoch_us(ts) between 0 and 604800000000")
def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of at most seven days before a fixed time; the limit itself still counts."""
    now = 1705708800.0
    at = events(spark, sf_dir).withColumn("saved_at", F.col("us") / 1e6)
    kept = listings.fresh(at.filter(F.col("saved_at") <= now), now)
    return kept.select("event_id", "user_id", (F.lit(int(now * 1e6)) - F.col("us")).alias("age_us"))


@query("""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
     k as (select doc_id, list_filter(w, lambda x: x not in ('the', 'and', 'for') and not regexp_matches(x, '^[a-z]$|^\\.[0-9]+$')) as k from w),
     x as (select doc_id, unnest(k) as x, unnest(range(len(k))) as i from k),
     d as (select doc_id, x, min(i) as i from x group by doc_id, x),
     j as (select doc_id, count(*) as n, string_agg(x, ' / ' order by i) as joined from d group by doc_id)
select k.doc_id, md5(regexp_replace(array_to_string(k, ' '), '^[ /]+|[ /]+$', '', 'g')) as tidy, coalesce(n, 0) as n_distinct, md5(coalesce(joined, '')) as joined from k left join j using (doc_id)""")
def token_filter_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without stop words and stray ones, joined; and each once in its first place."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    d = read(spark, sf_dir, "documents").select("doc_id", t.without_words(words, ["the", "and", "for"]).alias("w"))
    d = d.select("doc_id", "w", F.array_distinct(t.without_stray(F.col("w"))).alias("once"))
    return d.select("doc_id", F.md5(t.tidy(F.col("w")).cast("binary")).alias("tidy"), F.size("once").cast("long").alias("n_distinct"), F.md5(t.joined_once(F.col("once"), " / ").cast("binary")).alias("joined"))


@query("""
select distinct p_name || ' ' || p_size as name, case when regexp_matches(p_name || ' ' || p_size, '\\s[0-9]') then p_name end as before_weight,
       'SIG ' || p_size as noted, p_size::double as lead, case when p_size % 3 = 0 then '' else p_size || ' Grain ' || p_brand end as kind,
       p_size::double + 0.5 as value, case p_size % 4 when 0 then 'compressed' when 1 then 'long drop tube' when 2 then 'compressed, long drop tube' else '' end as flags,
       case p_size % 4 when 0 then 'amber:compressed' when 1 then 'green:most accurate' when 2 then 'plain:long tube|amber:compressed load' else '' end as badges
from part""")
def name_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names cut from labels, numbers and marks read from cells, flags as badges."""
    p = read(spark, sf_dir, "part")
    size, pick = F.col("p_size"), lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_size") % 4 + 1).cast("int"))
    name = F.concat_ws(" ", "p_name", "p_size")
    value, flags = t.value_and_flags(F.concat(F.lit(" "), size, F.lit(".5"), pick(" c", "•", " C• ", "")))
    tab = F.concat(size, F.lit(" Grain"), F.when(size % 3 == 0, "s").otherwise(F.concat(F.lit(" "), "p_brand")))
    marks = t.badges(pick("compressed", " most accurate,", "long tube, compressed load", ""))
    return p.select(
        name.alias("name"),
        t.name_before_weight(name).alias("before_weight"),
        t.without_link_note(F.concat(F.lit("SIG "), size, pick("- This link will open a PDF", " THIS LINK WILL OPEN", "-  this link will open it", ""))).alias("noted"),
        t.leading_number(F.concat(size, F.lit("gr"))).alias("lead"),
        t.bullet_type(tab).alias("kind"),
        value.alias("value"),
        flags.alias("flags"),
        F.array_join(F.transform(marks, lambda m: F.concat_ws(":", m["kind"], m["text"])), "|").alias("badges"),
    ).distinct()


@query("""
with p as (select distinct p_size as s, p_size % 5 as m from part)
select s, case m when 0 then s || '–' || s + 2 || '.5 gr' when 1 then s || ' gr (MAX)' when 2 then s || ' gr' when 3 then s || ' gr (start)' else '—' end as charge,
       case m when 0 then s || '–' || s + 900 || ' fps' when 1 then s + 900 || ' fps' when 2 then s + 900 || ' fps' else '—' end as velocity from p""")
def charge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges and velocities as a reader writes them: ranges, single values, starts, none."""
    s = F.col("s").cast("double")
    p = read(spark, sf_dir, "part").select(F.col("p_size").alias("s"), (F.col("p_size") % 5).alias("m")).distinct()
    when = lambda ms, x: F.when(F.col("m").isin(*ms), x)
    charge = t.charge_display(when((1, 2), s), when((0, 3), s), when((0,), s + 2.5), F.col("m") == 1)
    return p.select("s", charge.alias("charge"), t.velocity_display(when((0, 1, 2), s + 900), when((0,), s)).alias("velocity"))
