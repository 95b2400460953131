"""Scalar functions on text, as Column expressions inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where Python's splitlines breaks; Java's \R lacks three of them.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Abbreviations and what they stand for, whole tokens only.
ABBREVIATIONS = {
    "rem": "remington",
    "win": "winchester",
    "wby": "weatherby",
    "wsm": "winchester short magnum",
    "wssm": "winchester super short magnum",
    "rum": "remington ultra magnum",
    "ackley": "ackley improved",
    "ai": "ackley improved",
    "mag": "magnum",
    "spl": "special",
    "spc": "special",
    "cal": "caliber",
    "sw": "smith wesson",
    "gov": "government",
    "govt": "government",
    "auto": "automatic",
    "acp": "automatic colt pistol",
}


def strip(s: Column) -> Column:
    """White space of any script off both ends; trim() knows blanks only."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")


def split_lines(s: Column) -> Column:
    """Lines without their breaks; a break at the very end opens no further line, and an empty text has none."""
    whole = F.regexp_replace(s, rf"(?:{LINE_BREAK})\z", "")
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(whole, LINE_BREAK, -1))


def first_group(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match."""
    return F.when(F.rlike(s, F.lit(pattern)), F.regexp_extract(s, pattern, group))


def _expanded(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.flatten(F.transform(tokens, lambda t: F.split(F.coalesce(F.try_element_at(table, t), t), " ")))


def _tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(s, F.lit("×"), F.lit("x"))), F.lit("([a-z0-9]+)"), 1)


def _no_zeros(t: Column) -> Column:
    return F.when(F.rlike(t, F.lit("^0+$")), "0").otherwise(F.regexp_replace(t, "^0+", ""))


def raw_tokens(name: Column) -> Column:
    """Tokens in order, abbreviations spelled out, leading zeros off."""
    return F.transform(_expanded(_tokens(name)), _no_zeros)


def normal_tokens(name: Column) -> Column:
    joined = F.regexp_replace(name, r"(?i)\bs\s*&\s*w\b", "sw")
    bare = F.transform(_expanded(_tokens(joined)), lambda t: _no_zeros(F.regexp_replace(t, r"(?<=\d)mm$", "")))
    return F.array_sort(bare)


def normalize(name: Column) -> Column:
    """A name's key: spelled-out tokens without order, units or leading zeros."""
    return F.array_join(normal_tokens(name), " ")


def display_g(x: Column) -> Column:
    """A number in six significant digits without needless zeros; as a power of ten below 0.0001 and from a million on.

    A seventh digit of exactly five is rounded up. Null stays null.
    """
    told = F.format_string("%.5e", x)
    mantissa = F.regexp_replace(F.regexp_extract(told, r"^(-?[\d.]+)", 1), r"\.?0+$", "")
    power = F.regexp_extract(told, r"e([+-]\d+)$", 1).try_cast("int")
    plain = F.concat(F.regexp_extract(told, r"^(-?[\d.]+)", 1), F.lit("E"), power).try_cast("decimal(24,10)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    far = F.concat(mantissa, F.regexp_extract(told, r"(e[+-]\d+)$", 1))
    odd = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
    return F.when(x.isNull(), None).when(F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False)), odd).when((power < -4) | (power >= 6), far).otherwise(plain)


def charge_display(point: Column, low: Column, high: Column, is_max: Column | None = None) -> Column:
    """A range first, else the single charge, else the start alone."""
    both = F.concat(display_g(low), F.lit("–"), display_g(high), F.lit(" gr"))
    one = F.concat(display_g(point), F.lit(" gr"), F.lit("") if is_max is None else F.when(is_max, " (MAX)").otherwise(""))
    return F.when(low.isNotNull() & high.isNotNull(), both).when(point.isNotNull(), one).when(low.isNotNull(), F.concat(display_g(low), F.lit(" gr (start)"))).otherwise("—")


def velocity_display(point: Column, low: Column) -> Column:
    return F.when(low.isNotNull() & point.isNotNull(), F.concat(display_g(low), F.lit("–"), display_g(point), F.lit(" fps"))).when(point.isNotNull(), F.concat(display_g(point), F.lit(" fps"))).otherwise("—")


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def slug(s: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("query"))


def value_and_flags(cell: Column) -> tuple[Column, Column]:
    """``2870 c•`` -> 2870.0 and ``compressed, long drop tube``; a malformed number is null."""
    cell = strip(cell)
    tail = F.regexp_extract(cell, r"^[\d.]+\s*(.*)$", 1)
    flags = F.concat_ws(", ", F.when(F.contains(F.lower(tail), F.lit("c")), "compressed"), F.when(F.contains(tail, F.lit("•")), "long drop tube"))
    return F.nullif(F.regexp_extract(cell, r"^([\d.]+)", 1), F.lit("")).try_cast("double"), flags


def name_before_weight(label: Column) -> Column:
    """What stands before the last number that follows white space; all of it, if none does."""
    pattern = r"(?s)^(.*)\s\d+(?:\.\d+)?\b"
    return F.when(F.rlike(label, F.lit(pattern)), strip(F.regexp_extract(label, pattern, 1))).otherwise(label)


def without_link_note(label: Column) -> Column:
    return strip(F.get(F.split(label, r"(?i)-?\s*This link will open", 2), F.lit(0)))


def bullet_type(tab: Column) -> Column:
    return F.when(F.rlike(tab, F.lit(r"(?i)^\d+(?:\.\d+)?\s*Grains?$")), "").otherwise(tab)


def leading_number(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"^(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def without(s: Column, pattern: str) -> Column:
    return strip(F.regexp_replace(s, pattern, ""))


def absolute(url: Column, base: str) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(base), url))


def badges(flags: Column) -> Column:
    """Class and text of each flag; a compressed one outranks an accurate one."""
    some = F.filter(F.transform(F.split(flags, ","), strip), lambda f: f != "")
    kind = lambda f: F.when(F.contains(F.lower(f), F.lit("compress")), "amber").when(F.contains(F.lower(f), F.lit("accurate")), "green").otherwise("plain")
    return F.transform(some, lambda f: F.struct(kind(f).alias("kind"), f.alias("text")))


# Fixed value: what is left over from print, a single letter and a fraction without its whole.
STRAY = r"^[a-z]$|^\.\d+$"


def without_words(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(*words))


def without_stray(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: ~F.rlike(x, F.lit(STRAY)))


def tidy(tokens: Column) -> Column:
    """Tokens without stray ones, joined; blanks and slashes off both ends."""
    return F.regexp_replace(F.array_join(without_stray(tokens), " "), "^[ /]+|[ /]+$", "")


def joined_once(tokens: Column, by: str) -> Column:
    """Each token once, in its first place."""
    return F.array_join(F.array_distinct(tokens), by)
