"""Text scalars: names, limits, labels, ids, paths in nested values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _col

# Abbreviations in water names, and state names by code.
ABBREVIATIONS = {"lk": "lake", "res": "reservoir", "ck": "creek", "cr": "creek", "rv": "river", "mt": "mount", "st": "saint"}
STATES = ("SC", "NC", "GA", "TN", "VA", "AL", "FL")


def expand_abbreviations(name) -> Column:
    out = _col(name)
    for short, long in ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"(?i)\b{short}\b\.?", long)
    return out


def base_name(name) -> Column:
    """Without parentheses, state suffix and the words lake and reservoir; abbreviations spelt out."""
    out = F.regexp_replace(_col(name), r"\([^)]*\)", " ")
    out = F.regexp_replace(out, rf"(?i),?\s+({'|'.join(STATES)})\s*$", "")
    out = F.regexp_replace(expand_abbreviations(out), r"(?i)\b(lake|reservoir)\b", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def state_of(name) -> Column:
    return F.nullif(F.upper(F.regexp_extract(_col(name), rf"(?i)[,\s]({'|'.join(STATES)})\s*$", 1)), F.lit(""))


def title_case(text) -> Column:
    return F.initcap(F.lower(_col(text)))


def split_camel(text) -> Column:
    return F.regexp_replace(_col(text), r"(?<=[a-z0-9])(?=[A-Z])", " ")


def name_forms(name) -> Column:
    """The name without its parenthesis, and what stands in it."""
    outer = F.trim(F.regexp_replace(_col(name), r"\s*\([^)]*\)", ""))
    inner = F.nullif(F.trim(F.regexp_extract(_col(name), r"\(([^)]*)\)", 1)), F.lit(""))
    return F.array_compact(F.array(F.nullif(outer, F.lit("")), inner))


def split_list(text) -> Column:
    """Items of a list in prose: parted by commas, semicolons, slashes, `and`."""
    return F.filter(F.transform(F.split(_col(text), r"(?i)\s*(?:[,;/]|\band\b)\s*"), lambda x: F.trim(x)), lambda x: x != "")


def size_bounds(text) -> tuple[Column, Column]:
    """Least and greatest inches out of prose; null where not told."""
    t = F.lower(_col(text))
    # An empty find would cast to null too, at the price of an exception.
    number = lambda p, n=1: F.nullif(F.regexp_extract(t, p, n), F.lit("")).try_cast("double")
    span = r"(\d+(?:\.\d+)?)\s*(?:-|to|and)\s*(\d+(?:\.\d+)?)\s*(?:in|\")"
    low = F.coalesce(number(span), number(r"(\d+(?:\.\d+)?)\s*(?:-?\s*in\w*|\")\s*(?:minimum|min\b|or (?:longer|more|larger))"), number(r"(?:minimum|min\b|at least)\D{0,20}(\d+(?:\.\d+)?)"))
    high = F.coalesce(number(span, 2), number(r"(?:maximum|max\b|no more than|under)\D{0,20}(\d+(?:\.\d+)?)"))
    return low, high


def size_limit(text) -> Column:
    """struct<min,max> inches out of prose; null where neither is told."""
    low, high = size_bounds(text)
    return F.when(low.isNotNull() | high.isNotNull(), F.struct(low.alias("min"), high.alias("max")))


def creel_limit(text) -> Column:
    t = F.lower(_col(text))
    found = F.coalesce(F.nullif(F.regexp_extract(t, r"(\d+)\s*(?:fish\s*)?(?:per|/|a)\s*(?:person|day|angler)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(?:limit|creel)\D{0,15}(\d+)", 1), F.lit("")))
    return found.try_cast("int")


def authority(url, official: tuple[str, ...] = (".gov", ".mil"), academic: tuple[str, ...] = (".edu",)) -> Column:
    """A label of a url's host."""
    host = F.lower(F.regexp_extract(_col(url), r"^[a-z]+://([^/:?#]+)", 1))
    ends = lambda tails: F.lit(False) if not tails else F.when(host.rlike("(" + "|".join(t.replace(".", r"\.") for t in tails) + ")$"), True).otherwise(False)
    return F.when(host == "", "unknown").when(ends(official), "official").when(ends(academic), "academic").otherwise("other")


def names_water(text, names: Column) -> Column:
    """The first name all of whose words stand in the text, none followed by `county`; null without one."""
    t = F.lower(_col(text))
    words = lambda n: F.filter(F.split(F.lower(n), r"[^a-z0-9]+"), lambda w: w != "")
    has = lambda w: F.regexp_like(t, F.concat(F.lit(r"\b"), w, F.lit(r"\b(?!\s+county)")))
    return F.get(F.filter(names, lambda n: (F.size(words(n)) > 0) & F.forall(words(n), has)), F.lit(0))


def embedded_json(text) -> Column:
    """The outermost {...} or [...] of a text, or null."""
    return F.nullif(F.regexp_extract(_col(text), r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))


def escape_html(text) -> Column:
    out = _col(text)
    for sign, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(ref))
    return out


def fnv1a(text) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as eight hex digits. For text within the basic plane, whose code points are its units."""
    units = F.filter(F.transform(F.split(_col(text), ""), lambda c: F.when(c != "", F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))), lambda u: u.isNotNull())
    # The product of a 32-bit value and the 25-bit prime fits 64 bits.
    h = F.aggregate(units, F.lit(2166136261).cast("long"), lambda s, u: (s.bitwiseXOR(u) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def first_value(*values) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(_col(v).cast("string")), F.lit("")) for v in values))


def value_at(json, path: str) -> Column:
    """What stands at a dotted path of a JSON text, as text."""
    return F.get_json_object(_col(json), "$." + path)


def clamp_to_oxygen(top, bottom, anoxic) -> Column:
    """struct<top,bottom,conflict>: a band's deep end held above the depth without oxygen; where that lies at or above the band's shallow end the band stays and a conflict is told."""
    t, b, a = _col(top), _col(bottom), _col(anoxic)
    conflict = F.coalesce(a <= t, F.lit(False))
    return F.struct(t.alias("top"), F.when(conflict | a.isNull(), b).otherwise(F.least(b, a)).alias("bottom"), conflict.alias("conflict"))


def depth_ranges(text, limit: float = 200.0) -> Column:
    """array<struct<low,high,kind>> of depths in feet told in prose, up to a limit: fish where the words before speak of fish, water where of water or bottom, else unclear."""
    pattern = r"((?:\S+\s+){0,4})(\d+(?:\.\d+)?)(?:\s*(?:-|to)\s*(\d+(?:\.\d+)?))?\s*(?:feet|foot|ft)\b"
    t = F.lower(_col(text))
    part = lambda n: F.regexp_extract_all(t, F.lit(pattern), F.lit(n))
    before = part(1)
    kind = lambda s: F.when(s.rlike("fish|bass|crappie|holding|suspend|catch"), "fish").when(s.rlike("water|bottom|depth|deep"), "water").otherwise("unclear")
    rows = F.transform(F.arrays_zip(before.alias("b"), part(2).alias("l"), part(3).alias("h")), lambda x: F.struct(x["l"].cast("double").alias("low"), F.coalesce(F.nullif(x["h"], F.lit("")).try_cast("double"), x["l"].cast("double")).alias("high"), kind(x["b"]).alias("kind")))
    return F.filter(rows, lambda x: (x["low"] <= x["high"]) & (x["high"] <= limit))


def between_markers(text, start: str, end: str) -> Column:
    """What stands between two markers (regular expressions), the end's absence meaning the text's end; null without the start."""
    got = F.regexp_extract(_col(text), rf"(?s){start}(.*?)(?:{end}|\z)", 1)
    return F.when(_col(text).rlike(start), got)
