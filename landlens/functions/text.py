"""Text rules as native column expressions: no Python runs per row."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import CASHFLOW_WORDS, DISTRESS_WORDS, HYPE_WORDS, WEAK_TITLE_WORDS, contains_any

# Unicode white space plus the four separator control characters, spelled out: a class by property is slow for every character.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# White space that one space stands for, but for a single space: that is most of it, and stays as it is.
SPACE_RUN = rf"{SPACE}(?:(?<! )|(?={SPACE})){SPACE}*"
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# A word boundary where letters, numbers and "_" are words and combining marks are not.
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once and use it many times inside `body`.

    A one-element transform evaluates `value` once per row, where repeating the
    expression would multiply both the plan and the work.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_text(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, SPACE_RUN, " "))


def strip_blanks(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def normalize_lines(s: Column) -> Column:
    """Non-empty lines, each with its white space collapsed."""
    return F.filter(F.transform(F.split(s, r"\R|[\x1c-\x1e]"), normalize_text), lambda x: x != "")


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, str, str]:
    """Compatibility decomposition of the basic plane, by rule from the Unicode database.

    Returns (single sources, their targets, combining marks, JSON of longer targets).
    Precomposed Hangul is left composed: its decomposition is arithmetic, not a table.
    """
    singles, targets, marks, longer = [], [], [], {}
    for code in range(0x80, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if plain == ch:
            continue
        if len(plain) == 1:
            singles.append(ch)
            targets.append(plain)
        else:
            longer[ch] = plain
    return "".join(singles), "".join(targets), "".join(marks), json.dumps(longer, ensure_ascii=False)


def strip_accents(s: Column) -> Column:
    """Letters without their marks; ligatures and compatibility forms spelled out.

    Characters with a longer spelling are looked up once per text, however often they occur.
    """
    singles, targets, marks, longer = _accent_tables()
    long_chars = "".join(json.loads(longer))
    table = F.from_json(F.lit(longer), "map<string,string>")
    ascii_chars = "".join(map(chr, range(0x80)))

    def spelled(simple: Column) -> Column:
        others = F.array_distinct(F.split(F.translate(simple, ascii_chars, ""), ""))
        hits = F.filter(
            F.transform(others, lambda c: F.struct(c.alias("char"), F.try_element_at(table, c).alias("plain"))), lambda h: h["plain"].isNotNull()
        )
        return F.aggregate(hits, simple, lambda acc, h: F.replace(acc, h["char"], h["plain"]))

    def folded(simple: Column) -> Column:
        has_long = F.length(F.translate(simple, long_chars, "")) != F.length(simple)
        return F.when(has_long, spelled(simple)).otherwise(simple)

    return F.when(~s.rlike(r"[^\x00-\x7f]"), s).otherwise(let(F.translate(s, singles + marks, targets), folded))


@lru_cache(maxsize=1)
def _composed_letters() -> str:
    """JSON of letter + mark -> composed letter over the basic plane, by rule from the Unicode database.

    A letter of several marks is reached from each of its marks last, so their order in a text does not matter.
    """
    table = {}
    for code in range(0xC0, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        letter = chr(code)
        base, *marks = unicodedata.normalize("NFD", letter)
        if not marks or unicodedata.normalize("NFC", letter) != letter:
            continue
        for k, mark in enumerate(marks):
            rest = unicodedata.normalize("NFC", base + "".join(marks[:k] + marks[k + 1 :]))
            if len(rest) == 1 and unicodedata.normalize("NFC", rest + mark) == letter:
                table[rest + mark] = letter
    return json.dumps(table, ensure_ascii=False)


def compose(s: Column) -> Column:
    """Letters and the marks behind them as composed letters, where there are such.

    Only the distinct runs of a letter and its marks are looked up, the longest first. The text is bound: it is read more
    than once, and what it is made of would run as often.
    """
    return let(s, lambda text: F.when(text.rlike(r"\p{M}"), _composed(text)).otherwise(text))


def _composed(s: Column) -> Column:
    table = F.from_json(F.lit(_composed_letters()), "map<string,string>")

    def letter(run: Column) -> Column:
        def joined(chars: Column) -> Column:
            def add(acc: Column, mark: Column) -> Column:
                return let(F.concat(acc, mark), lambda both: F.coalesce(F.try_element_at(table, both), both))

            return F.aggregate(F.slice(chars, 2, F.size(chars)), F.get(chars, F.lit(0)), add)

        return F.struct((-F.length(run)).alias("order"), run.alias("run"), let(F.split(run, ""), joined).alias("letter"))

    runs = F.array_distinct(F.regexp_extract_all(s, F.lit(r"\P{M}\p{M}+"), F.lit(0)))
    return F.aggregate(F.array_sort(F.transform(runs, letter)), s, lambda acc, r: F.replace(acc, r["run"], r["letter"]))


def canonical(s: Column, fold_d: bool = False) -> Column:
    """Comparison key: collapsed spaces, no accents, lower case.

    The stroke letter đ has no decomposition and stays; `fold_d` maps it to d.
    """
    out = F.lower(let(normalize_text(s), strip_accents))
    return F.translate(out, "đ", "d") if fold_d else out


def line_keys(lines: Column, fold_d: bool = False) -> Column:
    """`canonical` of each already normalised line."""
    keys = F.transform(lines, lambda x: F.lower(strip_accents(x)))
    return F.transform(keys, lambda k: F.translate(k, "đ", "d")) if fold_d else keys


def keyed(lines: Column, fold_d: bool = False) -> Column:
    """Array of (line, key) for rules that test the key and return the line."""
    return F.zip_with(lines, line_keys(lines, fold_d), lambda x, k: F.struct(x.alias("line"), k.alias("key")))


def clean_numeric(s: Column) -> Column:
    """First number in a text; the later of ',' and '.' is the decimal mark."""
    number = F.regexp_extract(F.regexp_replace(s, rf"(?U)(?:~|{SPACE})+", ""), r"-?[\d.,]+", 0)

    def plain(v: Column) -> Column:
        both = v.contains(",") & v.contains(".")
        back = F.reverse(v)
        return (
            F.when(both & (F.instr(back, ",") < F.instr(back, ".")), F.translate(v, ",.", "."))
            .when(both, F.translate(v, ",", ""))
            .otherwise(F.translate(v, ",", "."))
        )

    # a failing cast makes an exception, which takes longer than all the rest
    return let(number, lambda v: F.when(v.rlike(r"\d"), plain(v))).try_cast("double")


# Fixed value: how prices in millions are written, on the accent-free key.
_MILLION = r"trieu|\btr\.?/"


def parse_money_total(s: Column) -> Column:
    """Total price in billions: amounts in millions are divided by 1000."""
    return let(s, lambda t: clean_numeric(t) / F.when(canonical(t).rlike(_MILLION), 1000.0).otherwise(1.0))


def parse_money_per_m2(s: Column) -> Column:
    """Unit price in millions: amounts in billions are multiplied by 1000."""

    def amount(t: Column) -> Column:
        scale = let(canonical(t), lambda k: F.when(~k.rlike(_MILLION) & k.contains("ty"), 1000.0).otherwise(1.0))
        return clean_numeric(t) * scale

    return let(s, amount)


def first_match(s: Column, patterns: list[tuple[str, int]]) -> Column:
    """Capture of the first pattern that matches; each comes with its group number."""
    # each match is bound: `nullif` reads it twice
    tries = [let(F.regexp_extract(s, "(?iU)" + p, g), lambda hit: F.nullif(hit, F.lit(""))) for p, g in patterns]
    return F.coalesce(*tries)


def find_line_containing(lines: Column, keywords: list[str]) -> Column:
    """First line whose key contains every keyword's key."""

    def all_in(item: Column) -> Column:
        out = F.lit(True)
        for word in keywords:
            out = out & item["key"].contains(plain_key(word))
        return out

    return F.get(F.filter(keyed(lines), all_in), F.lit(0))["line"]


def plain_key(word: str) -> str:
    """Python-side `canonical` for literals in rules."""
    flat = unicodedata.normalize("NFKD", " ".join(word.split()))
    return "".join(c for c in flat if not unicodedata.combining(c)).lower()


def find_line_after_label(lines: Column, labels: list[str], items: Column | None = None) -> Column:
    """The line below a label line, or the rest of a line that starts with the label; ``items`` are the lines' ``keyed``, if at hand."""

    def candidate(item: Column, i: Column) -> Column:
        key, line = item["key"], item["line"]
        tries = []
        for label in (plain_key(x) for x in labels):
            rest = F.btrim(F.substr(key, F.lit(len(label) + 1)), F.lit(" :-"))
            tries.append(F.when(key == label, F.get(lines, i + 1)))
            tries.append(F.when(key.startswith(label + " "), F.coalesce(F.nullif(rest, F.lit("")), line)))
        return F.coalesce(*tries)

    found = F.transform(keyed(lines) if items is None else items, candidate)
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


# Patterns for figures in free text, tried in order (pattern, group).
FEATURE_PATTERNS: dict[str, list[tuple[str, int]]] = {
    "price_total": [
        (r"Khoảng giá\s*\n\s*([\d.,]+\s*tỷ)", 1), (r"Giá\s*\n\s*([\d.,]+\s*tỷ)", 1),
        (r"([\d.,]+\s*tỷ)", 1), (r"([\d.,]+\s*triệu)", 1),
    ],
    "price_per_m2": [
        (r"([\d.,]+\s*triệu\s*/\s*m²)", 1), (r"([\d.,]+\s*tr\.?\s*/\s*m²)", 1), (r"([\d.,]+\s*tr/m²)", 1),
    ],
    "area": [(r"Diện tích\s*\n\s*([\d.,]+\s*m²)", 1), (r"([\d.,]+\s*m²)", 1)],
    "frontage": [(r"Mặt tiền\s*([\d.,]+)\s*m", 1), (r"Ngang\s*([\d.,]+)\s*m", 1)],
    "road_width": [(r"Đường vào\s*([\d.,]+)\s*m", 1), (r"Hẻm\s*([\d.,]+)\s*m", 1)],
    "bedrooms": [(r"(\d+)\s*PN\b", 1), (r"Phòng ngủ\s*([\d]+)", 1), (r"(\d+)\s*phòng ngủ", 1)],
    "bathrooms": [(r"(\d+)\s*WC\b", 1), (r"(\d+)\s*toilet\b", 1), (r"Phòng tắm\s*([\d]+)", 1)],
    "floors": [(r"(\d+)\s*tầng", 1), (r"(\d+)\s*lầu", 1), (r"(\d+)\s*floor", 1)],
    "direction": [
        (
            r"Hướng nhà\s*([A-Za-zÀ-Ỵà-ỵ]+(?:\s*-\s*[A-Za-zÀ-Ỵà-ỵ]+)?(?:\s+[A-Za-zÀ-Ỵà-ỵ]+)?)"
            r"\s*(?=Hướng ban công|Pháp lý|Nội thất|$)", 1,
        ),
        (r"Hướng nhà\s*([A-Za-zÀ-Ỵà-ỵ]+(?:\s*-\s*[A-Za-zÀ-Ỵà-ỵ]+)?(?:\s+[A-Za-zÀ-Ỵà-ỵ]+)?)", 1),
    ],
    "posted_date": [(r"Ngày đăng\s*([0-3]?\d/[0-1]?\d/\d{4})", 1)],
    "expiry_date": [(r"Ngày hết hạn\s*([0-3]?\d/[0-1]?\d/\d{4})", 1)],
}


def _date_below(lines: Column, label: str, items: Column | None = None) -> Column:
    """First dated line among the three lines below the first line equal to a label."""
    keys = line_keys(lines) if items is None else F.transform(items, lambda x: x["key"])
    at = F.array_position(keys, plain_key(label)).cast("int")
    window = F.slice(lines, at + 1, 3)
    dated = F.filter(window, lambda x: x.rlike(r"\d{2}/\d{2}/\d{4}"))
    return F.when(at > 0, F.get(dated, F.lit(0)))


def numeric_features(text: Column, lines: Column, line_labels: tuple[str, str] = ("ngay dang", "ngay het han")) -> dict[str, Column]:
    """The twelve figures of a free text, each by its ordered patterns; marks may stand apart from their letters."""
    return figures_of_composed(compose(text), lines, line_labels)


def figures_of_composed(
    text: Column, lines: Column, line_labels: tuple[str, str] = ("ngay dang", "ngay het han"), items: Column | None = None
) -> dict[str, Column]:
    """`numeric_features` of a text that `compose` gave; ``items`` are the lines' ``keyed``, if at hand."""
    from .dates import parse_date

    raw = {name: first_match(text, patterns) for name, patterns in FEATURE_PATTERNS.items()}
    whole = lambda c: c.try_cast("double").cast("int")
    return {
        "price_total": parse_money_total(raw["price_total"]),
        "price_per_m2": parse_money_per_m2(raw["price_per_m2"]),
        "area": clean_numeric(raw["area"]),
        "frontage": clean_numeric(raw["frontage"]),
        "road_width": clean_numeric(raw["road_width"]),
        "bedrooms": whole(raw["bedrooms"]),
        "bathrooms": whole(raw["bathrooms"]),
        "floors": whole(raw["floors"]),
        "direction": normalize_text(raw["direction"]),
        "legal_status": F.coalesce(
            find_line_after_label(lines, ["Pháp lý", "Phap ly"], items), F.lit("Sổ hồng/Sổ đỏ")
        ),
        "posted_date": parse_date(F.coalesce(raw["posted_date"], _date_below(lines, line_labels[0], items))),
        "expiry_date": parse_date(F.coalesce(raw["expiry_date"], _date_below(lines, line_labels[1], items))),
    }


def keyword_flags(text: Column) -> dict[str, Column]:
    """Four seller-tone flags; a missing text counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return {
        "has_ngop_kw": contains_any(low, DISTRESS_WORDS),
        "has_marketing_kw": contains_any(low, HYPE_WORDS),
        "has_dongtien_kw": contains_any(low, CASHFLOW_WORDS),
        "has_phaply_yeu_kw": contains_any(low, WEAK_TITLE_WORDS),
    }


def style_features(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    return {
        "desc_len": F.length(t).cast("long"),
        "exclamation_count": F.regexp_count(t, F.lit("!")).cast("long"),
        "caps_lock_ratio": F.regexp_count(t, F.lit(r"\p{Lu}")) / (F.length(t) + 1),
    }


# Amenity patterns, applied to the accent-free key of a description.
AMENITY_PATTERNS = {
    "has_elevator": r"thang\s*may|elevat",
    "near_park": r"cong\s*vien|bo\s*song|ho\s*nuoc|view\s*thong\s*thoang",
    "is_frontage_road": r"mat\s*tien\s*duong|mat\s*duong",
}


def description_flags(text: Column, fold_d: bool = False, key: Column | None = None) -> dict[str, Column]:
    """Amenities a description names; ``key`` is the text's ``canonical``, if at hand."""
    key = canonical(F.coalesce(text, F.lit("")), fold_d) if key is None else key
    return {name: key.rlike("(?U)" + p) for name, p in AMENITY_PATTERNS.items()}


def product_id(url: Column, text: Column | None = None) -> Column:
    """Digits after `pr` in the address, else in the text, else an empty string."""
    tries = [F.nullif(F.regexp_extract(c, r"(?i)pr(\d+)", 1), F.lit("")) for c in (url, text) if c is not None]
    return F.coalesce(*tries, F.lit(""))
