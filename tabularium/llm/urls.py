"""URL filter by rules on host and path, then by a weighted vocabulary.

A rule fits its host and all subdomains, if the path starts with the rule's;
the longest fitting rule wins. Where none fits, an Aho-Corasick automaton finds
the vocabulary's terms in the lower-cased url. A term counts where no letter or
digit stands beside it. Each different term adds its weight, in tenths, once: a
strict one (``REJECT`` or more) blocks alone, soft ones block together when
their weights reach ``REJECT``.

The vocabulary is a table of terms and weights, ``url_terms.tsv`` unless another
is given; see :func:`load_terms`. It goes to the executors whole, so it must be
of at most ``MOST_TERM_BYTES``.

Defined cases: a null url or one without ``://`` has empty host and path, meets
no rule, and its text (null: empty) still goes through the vocabulary; repeated
rows give repeated results; a hit that lies in a longer hit counts on its own;
of rules of equal length the earlier one wins; no rows give none; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
REJECT = 10
TERMS_FILE = "url_terms.tsv"
MOST_TERM_BYTES = 64_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _fits(host: Column, path: Column, rule: str) -> Column:
    at, _, rest = rule.partition("/")
    return ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)


def load_terms(path: str | None = None) -> dict[str, int]:
    """Terms and weights of a file of lines ``term<TAB>weight``; ``#`` opens a remark. Of a term that repeats the greatest weight holds."""
    text = (resources.files(__package__) / TERMS_FILE).read_text("utf-8") if path is None else open(path, encoding="utf-8").read()
    out: dict[str, int] = {}
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            term, _, weight = line.partition("\t")
            if not term.strip() or int(weight) <= 0:
                raise ValueError(f"no term with a positive weight: {line!r}")
            term = term.strip().lower()
            out[term] = max(out.get(term, 0), int(weight))
    if sum(len(t.encode()) for t in out) > MOST_TERM_BYTES:
        raise ValueError(f"the vocabulary has more than {MOST_TERM_BYTES} bytes")
    return out


@lru_cache(maxsize=8)
def _automaton(terms: tuple[tuple[str, int], ...]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for k, (term, weight) in enumerate(terms):
        machine.add_word(term, (k, len(term), weight))
    machine.make_automaton()
    return machine


def count_terms(text: str, terms: tuple[tuple[str, int], ...]) -> tuple[int, int, int]:
    """Distinct strict and distinct soft terms of a lower-cased text, by whole terms, and their weight together."""
    found = {}
    if terms:
        for end, (k, n, weight) in _automaton(terms).iter(text):
            before, after = end - n, end + 1
            if (before < 0 or not text[before].isalnum()) and (after >= len(text) or not text[after].isalnum()):
                found[k] = weight
    hard = sum(w >= REJECT for w in found.values())
    return hard, len(found) - hard, sum(found.values())


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, terms: Mapping[str, int] | None = None) -> DataFrame:
    """``id, host, path, rule, verdict, n_strict, n_soft, weight`` for every row."""
    known = tuple(sorted((load_terms() if terms is None else terms).items()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [count_terms((u or "").lower(), known) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([h[k] for h in hits], pa.int32()) for k in range(3))], names=["_id", "_url", "n_strict", "n_soft", "weight"])

    slim = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    schema = f"_id {slim.schema['_id'].dataType.simpleString()}, _url string, n_strict int, n_soft int, weight int"
    host, path = host_path(F.col("_url"))
    at = slim.mapInArrow(counted, schema).withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the longest is asked first, as it wraps the others
        fits = _fits(F.col("host"), F.col("path"), text)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    own = F.when(F.col("weight") >= REJECT, "block").otherwise("allow")
    return at.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_strict", "n_soft", "weight")


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    bound = lambda t: f"regexp_matches(lower(coalesce(url, '')), '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')"
    add = lambda of: " + ".join(of) or "0"
    terms = load_terms()
    hard = add(f"{bound(t)}::int" for t, w in terms.items() if w >= REJECT)
    mild = add(f"{bound(t)}::int" for t, w in terms.items() if w < REJECT)
    whole = add(f"{w} * {bound(t)}::int" for t, w in terms.items())
    rule = verdict = ""
    for kind, text in sorted(RULES, key=lambda r: -len(r[1])):
        at, _, rest = text.partition("/")
        fits = f"when (host = '{at}' or ends_with(host, '.{at}')) and starts_with(path, '/{rest}') then "
        rule, verdict = rule + fits + f"'{text}' ", verdict + fits + f"'{kind}' "
    return f"""
with a as (
  select page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
         cast({hard} as integer) as n_strict, cast({mild} as integer) as n_soft, cast({whole} as integer) as weight
  from pages)
select page_id, host, path, case {rule}end as rule,
       case {verdict}when weight >= {REJECT} then 'block' else 'allow' end as verdict,
       n_strict, n_soft, weight
from a"""
