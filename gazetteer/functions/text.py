"""Text expressions: tokens, folding, entity text, abbreviations, house-number shapes, names, templates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{IsAlphabetic}\p{N}]+"

_BASE = {"a": "àáâãäåā", "c": "çćč", "e": "èéêëēę", "i": "ìíîïī", "n": "ñńň", "o": "òóôõöøō", "u": "ùúûüū", "y": "ýÿ", "s": "śš", "z": "źžż", "l": "ł", "d": "ď", "t": "ť", "r": "ř"}
_MANY = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}


def fold(text: Column) -> Column:
    """Lower case with accents off Latin letters; letters that fold to several are spelled out."""
    src = "".join(_BASE.values())
    dst = "".join(k * len(v) for k, v in _BASE.items())
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), _MANY.items(), F.translate(F.lower(text), src, dst))


def tokens_strict(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens_lower(text: Column) -> Column:
    return tokens_strict(F.lower(text))


def tokens_folded(text: Column) -> Column:
    return tokens_strict(fold(text))


def entity_text(name: Column, post_code: Column) -> Column:
    """Name, trimmed post code, and the post code's digits where they differ from it; a blank post code counts as none."""
    code = F.nullif(F.trim(post_code), F.lit(""))
    digits = F.regexp_replace(code, "[^0-9]", "")
    return F.concat_ws(" ", name, code, F.when((digits != code) & (digits != ""), digits))


def expand_abbreviations(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The text and, for each (long, short) pair found in its lower case, a variant with one put for the other."""
    low = F.lower(text)
    variants = [F.when(F.contains(low, F.lit(a)), F.replace(low, F.lit(a), F.lit(b))).when(F.contains(low, F.lit(b)), F.replace(low, F.lit(b), F.lit(a))) for a, b in pairs]
    return F.concat_ws(" ", text, *variants)


def token_coverage(query: Column, document: Column) -> Column:
    """Share of the query's tokens, each time it occurs, that the document holds; 0 without query tokens."""
    found = F.size(F.filter(query, lambda t: F.array_contains(document, t)))
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(found / F.size(query))


def fuzzy_distance(token: Column) -> Column:
    return F.when(F.length(token) < 4, 1).otherwise(2)


def leading_number(text: Column) -> Column:
    return F.regexp_extract(text, "^[0-9]+", 0).try_cast("long")


def canonical_house_number(number: Column) -> Column:
    """`12 a`, `12-a` and `12a` become `12A`; anything else stays, trimmed."""
    n = F.trim(number)
    digits, letter = F.regexp_extract(n, "^([0-9]+)[ -]?([A-Za-z])$", 1), F.regexp_extract(n, "^([0-9]+)[ -]?([A-Za-z])$", 2)
    return F.when(digits != "", F.concat(digits, F.upper(letter))).otherwise(n)


def house_token(token: Column) -> Column:
    """The token without one trailing comma, if it has a house number's shape; else null."""
    core = F.regexp_replace(token, ",$", "")
    return F.when(core.rlike("^[0-9]{1,5}[A-Za-z]?$"), core)


def first_house_number(query: Column, street: Column) -> Column:
    """The first house-number token of a query that is not a word of the street's name."""
    names = F.transform(tokens_strict(street), F.lower)
    shaped = F.filter(F.transform(F.split(F.trim(query), r"\s+"), house_token), lambda t: t.isNotNull() & ~F.array_contains(names, F.lower(t)))
    return F.try_element_at(shaped, F.lit(1))


def parse_coordinates(text: Column) -> Column:
    """struct<lat, lon> of `lat,lon` with both in range; else null."""
    at = F.instr(text, ",")
    lat = F.when(at > 0, F.trim(F.substring(text, F.lit(1), at - 1)).try_cast("double"))
    lon = F.when(at > 0, F.trim(F.substring(text, at + 1, F.length(text))).try_cast("double"))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def name_by_priority(tags: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.try_element_at(tags, F.lit(k)) for k in (keys or ["name"])])


def clean_code(*values: Column) -> Column:
    """The first of the values there is, trimmed and upper-cased; empty is null."""
    v = F.upper(F.trim(F.coalesce(*values)))
    return F.nullif(v, F.lit(""))


def pack_id(osm_id: Column, relation: Column) -> Column:
    return F.shiftleft(osm_id, 1).bitwiseOR(F.when(relation, F.lit(1)).otherwise(F.lit(0)).cast("long"))


# --- friendly names ----------------------------------------------------------------------------------------------------


def parse_template(template: str) -> list[tuple[str, str]]:
    """(kind, value) of a friendly-name template: text, level (0 to 255) or house_number.  A brace that opens must close
    around a known field; one that only closes is text."""
    out, rest = [], template
    while rest:
        if rest[0] != "{":
            text = rest.partition("{")[0]
            out.append(("text", text))
            rest = rest[len(text) :]
            continue
        inner, closes, rest = rest[1:].partition("}")
        if not closes:
            raise ValueError("friendly_name_format: unterminated placeholder (missing closing '}')")
        m = re.fullmatch(r"admin_level_(.*)_name", inner, re.S)
        if inner == "house_number":
            out.append(("house_number", ""))
        elif not m:
            raise ValueError(f"friendly_name_format: unknown field '{inner}' (expected 'admin_level_<N>_name' or 'house_number')")
        elif not (m[1].isascii() and m[1].isdigit() and int(m[1]) < 256):
            raise ValueError(f"friendly_name_format: invalid admin level '{m[1]}' (expected an integer 0-255)")
        else:
            out.append(("level", m[1]))
    return out


def render_template(template: str, names_by_level: Column, house_number: Column) -> Column:
    """The template with a map of level to name; a missing value takes the text right after it along."""
    parts, kept = [], None
    for kind, value in parse_template(template):
        if kind == "text":
            parts.append(F.lit(value) if kept is None else F.when(kept, F.lit(value)).otherwise(F.lit("")))
            kept = None
        else:
            v = F.try_element_at(names_by_level, F.lit(int(value))) if kind == "level" else house_number
            parts.append(F.coalesce(v, F.lit("")))
            kept = v.isNotNull()
    return F.regexp_replace(F.concat(F.lit(""), *parts), r"^[,\s]+|[,\s]+$", "")


def default_friendly_name(levels: Column) -> Column:
    """Names of array<struct<level, name>>: street (12), house number (30), then from the most specific on."""
    order = lambda x: F.when(x["level"] == 12, -2).when(x["level"] == 30, -1).otherwise(100 - x["level"])
    keyed = F.transform(levels, lambda x, i: F.struct(order(x).alias("k"), i.alias("i"), x["name"].alias("name")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["name"]), ", ")


def unpack_id(packed: Column) -> Column:
    """struct<osm_id, relation> of a packed id."""
    return F.struct(F.shiftright(packed, 1).alias("osm_id"), (packed.bitwiseAND(F.lit(1)) == 1).alias("relation"))


def url_decode(s: str) -> str:
    """%xx and + decoded; bad escapes stay as they are; bytes that are no UTF-8 become the replacement character."""
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), s.replace("+", " ").encode())
    return raw.decode("utf-8", "replace")


def query_param(query_string: str, key: str) -> str | None:
    """The first parameter whose decoded name is `key`."""
    for pair in query_string.split("&"):
        k, given, v = pair.partition("=")
        if given and url_decode(k) == key:
            return url_decode(v)
    return None
