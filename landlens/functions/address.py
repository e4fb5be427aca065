"""Address rules: split an address line into city, district, ward and street."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical, find_line_containing, keyed, let, normalize_text

# Tokens on the accent-free key.
CITY_TOKENS = (
    "ho chi minh", "hcm", "ha noi", "da nang", "hai phong", "can tho",
    "binh duong", "dong nai", "khanh hoa", "lam dong",
)
CITY_TOKENS_ADDRESS = CITY_TOKENS + ("tp.", "tphcm")
DISTRICT_TOKENS = ("quan", "huyen", "thi xa", "thanh pho")
WARD_TOKENS = ("phuong", "xa", "thi tran")
NEAR_TITLE_TOKENS = ("phuong", "xa", "quan", "huyen", "duong", "ho chi minh", "ha noi")
ANYWHERE_TOKENS = ("quan", "huyen", "phuong", "xa")
STREET_PREFIX = r"(?U)^(?:duong|hem|pho|ngo|ngach)\b|^(?:quoc lo|tinh lo)\b|^(?:ql|tl|dt)(?:\b|\d)"


def address_parts(address: Column) -> Column:
    return F.filter(F.transform(F.split(address, ","), normalize_text), lambda x: x != "")


def _has_token(key: Column, tokens: tuple[str, ...]) -> Column:
    return key.rlike("|".join(t.replace(".", r"\.") for t in tokens))


def _first_with(items: Column, tokens: tuple[str, ...]) -> Column:
    """Line of the first (line, key) item whose key holds a token."""
    return F.get(F.filter(items, lambda p: _has_token(p["key"], tokens)), F.lit(0))["line"]


def street_part(parts: Column) -> Column:
    """First part that begins like a street, alley or highway name."""
    return F.get(F.filter(keyed(parts, True), lambda p: p["key"].rlike(STREET_PREFIX)), F.lit(0))["line"]


def parse_address(address: Column, fold_d: bool = False) -> Column:
    """Struct of an address line, scanned from its end."""
    parts = address_parts(F.coalesce(address, F.lit("")))
    return let(F.reverse(keyed(parts, fold_d)), lambda back: _address(back, address))


def _address(back: Column, address: Column) -> Column:
    city = F.btrim(F.regexp_replace(_first_with(back, CITY_TOKENS_ADDRESS), r"TP\.|Tp\.|TP", ""))
    district = _first_with(back, DISTRICT_TOKENS)
    return F.struct(
        F.coalesce(city, F.get(back, F.lit(0))["line"], F.lit("")).alias("city"),
        F.coalesce(district, F.get(back, F.lit(1))["line"], F.lit("")).alias("district"),
        _first_with(back, WARD_TOKENS).alias("ward"),
        street_part(F.transform(F.reverse(back), lambda x: x["line"])).alias("street"),
        address.alias("full_address"),
    )


def parse_location(lines: Column, title: Column, fold_d: bool = False) -> Column:
    """Struct of the address line found near the title, anywhere, or in the breadcrumb."""
    chosen = let(
        F.struct(keyed(lines, fold_d).alias("items"), canonical(title, fold_d).alias("title")),
        lambda x: _location_line(x["items"], x["title"], lines, title),
    )
    return let(chosen, lambda line: let(keyed(address_parts(line), fold_d), lambda items: _location(items, line)))


def _location_line(items: Column, title_key: Column, lines: Column, title: Column) -> Column:
    at = F.array_position(F.transform(items, lambda x: x["key"]), title_key).cast("int")
    near = F.when(at > 0, F.slice(items, at + 1, 9)).otherwise(F.slice(items, 1, 20))

    def line_with(space: Column, tokens: tuple[str, ...]) -> Column:
        hits = F.filter(space, lambda x: x["line"].contains(",") & _has_token(x["key"], tokens))
        return F.get(hits, F.lit(0))["line"]

    return F.coalesce(
        line_with(near, NEAR_TITLE_TOKENS),
        line_with(items, ANYWHERE_TOKENS),
        F.nullif(find_line_containing(lines, ["Bán/"]), F.lit("")),
        title,
    )


def _location(items: Column, line: Column) -> Column:
    n = F.size(items)
    city = F.btrim(F.regexp_replace(_first_with(items, CITY_TOKENS), r"TP\.|Tp\.", ""))
    two = n >= 2
    return F.struct(
        F.coalesce(city, F.when(two, F.get(items, n - 1)["line"]), F.lit("")).alias("city"),
        F.coalesce(_first_with(items, DISTRICT_TOKENS), F.when(two, F.get(items, n - 2)["line"]), F.lit("")).alias("district"),
        _first_with(items, WARD_TOKENS).alias("ward"),
        street_part(F.transform(items, lambda x: x["line"])).alias("street"),
        line.alias("full_address"),
    )
