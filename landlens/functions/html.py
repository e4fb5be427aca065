"""Page rules without a DOM: a page is cut into tags once; elements are runs of tags up to their own end tag.

Every helper is a native column expression. Patterns use no nested repetition, so a
broken page costs linear time and cannot exhaust the matcher's stack.
"""

from __future__ import annotations

import html as _entities
import json
from collections.abc import Callable
from functools import reduce
from itertools import count
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_RUN, let, normalize_text

NO_TEXT = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|template\b.*?</template\s*>)"


def drop_silent(page: Column) -> Column:
    """Page without comments, scripts, styles and templates, its references decoded.

    References that stand for markup characters keep one spelling each and are
    decoded by `unescape` after the tags are gone. All others are decoded here, once
    per page.
    """
    return decode_references(F.regexp_replace(page, NO_TEXT, " "))


# Markup characters and the reference each keeps until its text is cut out.
MARKUP = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}


def _named_references() -> str:
    table = {k[:-1]: MARKUP.get(v, v) for k, v in _entities.entities.html5.items() if k.endswith(";")}
    return json.dumps(table, ensure_ascii=False)


def decode_references(s: Column) -> Column:
    """Replace named and numeric character references that are not markup."""
    table = F.from_json(F.lit(_named_references()), "map<string,string>")

    def code_point(n: Column) -> Column:
        ok = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        char = F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        kept = F.lit(None).cast("string")
        for mark, reference in MARKUP.items():
            kept = F.coalesce(kept, F.when(n == ord(mark), F.lit(reference)))
        return F.coalesce(kept, char)

    def character(name: Column) -> Column:
        # only what is a number is cast: a failing cast makes an exception, which takes longer than all the rest
        dec = F.when(name.rlike(r"^#\d{1,8}$"), F.substr(name, F.lit(2)).try_cast("bigint"))
        hexa = F.when(name.rlike(r"^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substr(name, F.lit(3)), 16, 10).try_cast("bigint"))
        return (
            F.when(name.isin("amp", "lt", "gt", "quot", "apos"), F.concat(F.lit("&"), name, F.lit(";")))
            .when(name == "nbsp", "\u00a0")
            .when(name.startswith("#"), code_point(F.coalesce(dec, hexa)))
            .otherwise(F.try_element_at(table, name))
        )

    def joined(parts: Column) -> Column:
        named = F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
            lambda p: F.struct(p.alias("text"), F.regexp_extract(p, r"^(#?\w{1,32});", 1).alias("name")),
        )
        return let(named, lambda tail: F.concat(F.get(parts, F.lit(0)), F.array_join(spelled(tail), "")))

    def spelled(tail: Column) -> Column:
        # every name is looked up once per page
        names = F.array_distinct(F.transform(tail, lambda p: p["name"]))
        found = F.filter(F.transform(names, lambda n: F.struct(n.alias("name"), character(n).alias("char"))), lambda e: e["char"].isNotNull())

        def piece(p: Column, char: Column) -> Column:
            return F.when(char.isNull(), F.concat(F.lit("&"), p["text"])).otherwise(F.concat(char, F.substr(p["text"], F.length(p["name"]) + 2)))

        return let(F.map_from_entries(found), lambda known: F.transform(tail, lambda p: let(F.try_element_at(known, p["name"]), lambda c: piece(p, c))))

    return let(F.split(s, "&"), joined)


def unescape(s: Column) -> Column:
    """Decode the markup references that `drop_silent` leaves; `&amp;` comes last."""
    for mark, reference in reversed(MARKUP.items()):
        s = F.replace(s, F.lit(reference), F.lit(mark))
    return s


def inner_text(markup: Column, gap: str = "") -> Column:
    """Text of a markup fragment: tags become `gap`, references are decoded."""
    return normalize_text(unescape(F.regexp_replace(markup, r"(?s)<[a-zA-Z/!?][^>]*>", gap)))


def page_text(page: Column) -> Column:
    """Visible text of a page with a space between elements."""
    return inner_text(drop_silent(page), " ")


def tags(quiet: Column) -> Column:
    """Tags of a page after `drop_silent`, in order: array of (name, end, head, classes, text).

    The page is cut once, at every "<". `head` is what stands between the angle brackets of
    an opening tag, `classes` its class list with a space on both sides of every class, and
    `text` what follows up to the next tag. Text in front of the first tag, and a "<" that
    opens no tag, make entries without a name.
    """

    def entry(piece: Column, i: Column) -> Column:
        # a tag's piece begins with a letter or one of /!? and has the closing bracket; parts of it are cut anew, which is faster than to bind them
        begins = reduce(or_, [(piece >= low) & (piece < chr(ord(high) + 1)) for low, high in ("az", "//", "AZ", "!!", "??")])
        h = F.substring_index(piece, ">", 1)
        # a class list is rare among tags, so most skip its pattern; white space in it is one space already, but for what the pattern finds
        listed = F.when(
            h.contains("class") | h.contains("CLASS"), F.regexp_replace(_value(h, "class"), r"\s(?:(?<! )|(?=\s))\s*", " ")
        ).otherwise("")
        tag = F.struct(
            F.lower(F.regexp_extract(h, r"^/?([a-zA-Z][\w-]*)", 1)).alias("name"),
            piece.startswith("/").alias("end"),
            F.when(piece.startswith("/"), "").otherwise(h).alias("head"),
            F.concat(F.lit(" "), listed, F.lit(" ")).alias("classes"),
            F.substr(piece, F.length(h) + 2).alias("text"),
        )

        def plain(text: Column) -> Column:
            return F.struct(
                F.lit("").alias("name"), F.lit(False).alias("end"), F.lit("").alias("head"), F.lit(" ").alias("classes"), text.alias("text")
            )

        return F.when((i > 0) & begins & piece.contains(">"), tag).otherwise(plain(F.when(i == 0, piece).otherwise(F.concat(F.lit("<"), piece))))

    return F.transform(F.split(quiet, "<"), entry)


# The rules below are SQL text over the name of a column (or of a lambda's variable): an
# expression of many parts then reaches Spark in one call, where a column object takes a
# call for every part of it. `F.expr` makes a column of the text.

# Tags looked through for an end tag before all the rest of the page is.
NEAR = 24
_DEPTH = 1 << 32
_fresh = count()


def bound(value: str, body: Callable[[str], str]) -> str:
    """`let` for SQL text."""
    name = f"b{next(_fresh)}"
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def _closing(inside: str, name: str) -> str:
    """Number of tags in front of the one that ends an open element of a name, null when none does."""
    # one number holds the depth and the tags so far while the element is open, and -1 - n once n tags stand in front of its end
    return (
        f"aggregate({inside}, {_DEPTH}L, (s, t) -> CASE WHEN s < 0L THEN s WHEN t.name <> {name} THEN s + 1L WHEN NOT t.end THEN s + {_DEPTH + 1}L "
        f"WHEN s < {2 * _DEPTH}L THEN {_DEPTH - 1}L - s ELSE s - {_DEPTH - 1}L END, s -> CASE WHEN s < 0L THEN CAST(-1L - s AS INT) END)"
    )


def _wanted(token: str, name: str | None) -> str:
    return (f"contains(t.classes, ' {token} ') AND " if token else "") + (f"t.name = '{name}'" if name else "t.name <> ''")


def _size(page: str, i: str) -> str:
    """Number of tags inside the element that tag ``i`` (from 0) opens."""
    name = f"get({page}, {i}).name"
    near, rest = _closing(f"slice({page}, {i} + 2, {NEAR})", name), _closing(f"slice({page}, {i} + 2, size({page}))", name)
    return f"coalesce({near}, {rest}, size({page}))"


def each_element(page: str, token: str, body: Callable[[str, str, str], str], name: str | None = None) -> str:
    """What ``body`` makes of the head, the tags inside, and the tags with their texts (its own first), of each element.

    Like `elements`, but the tags are not copied into the result.
    """

    def element(i: str) -> str:
        def parts(n: str) -> str:
            return bound(f"slice({page}, {i} + 2, {n})", lambda inner: body(f"get({page}, {i}).head", inner, f"slice({page}, {i} + 1, {n} + 1)"))

        return bound(_size(page, i), parts)

    places = f"filter(transform({page}, (t, k) -> CASE WHEN {_wanted(token, name)} AND NOT t.end THEN k END), k -> k IS NOT NULL)"
    i = f"b{next(_fresh)}"
    return f"transform({places}, {i} -> {element(i)})"


def elements(page: str, token: str, name: str | None = None) -> str:
    """Elements of a class among tags, in page order: array of (name, head, classes, inner).

    `inner` holds the tags inside an element; its first entry is the opening tag without its
    name and classes, for the text behind it. An element that is never closed reaches to the
    end. Without a token the elements of a tag name are found.
    """
    wanted = _wanted(token, name)

    def found(every: str) -> str:
        def element(own: str) -> str:
            near, rest = _closing(f"slice({every}, i + 2, {NEAR})", f"{own}.name"), _closing(f"slice({every}, i + 2, size({every}))", f"{own}.name")
            first = f"named_struct('name', '', 'end', false, 'head', '', 'classes', ' ', 'text', {own}.text)"
            inner = f"concat(array({first}), slice({every}, i + 2, coalesce({near}, {rest}, size({every}))))"
            return f"named_struct('name', {own}.name, 'head', {own}.head, 'classes', {own}.classes, 'inner', {inner})"

        places = f"filter(transform({every}, (t, k) -> CASE WHEN {wanted} AND NOT t.end THEN k END), k -> k IS NOT NULL)"
        return f"transform({places}, i -> {bound(f'get({every}, i)', element)})"

    return bound(page, found)


def has_class(page: str, token: str) -> str:
    return f"exists({page}, t -> contains(t.classes, ' {token} '))"


def _normalized(text: str) -> str:
    return f"btrim(regexp_replace({text}, {literal(SPACE_RUN)}, ' '))"


def tag_text(inner: str, gap: str = "") -> str:
    """Text of a run of tags: tags become `gap`, references are decoded."""
    text = f"array_join(transform({inner}, t -> t.text), '{gap}')"
    return _normalized(_decoded(text))


def first_inner(page: str, token: str, name: str | None = None) -> str:
    return f"get({elements(page, token, name)}, 0).inner"


def first_text(page: str, token: str, name: str | None = None, gap: str = "") -> str:
    """Normalised text of the first element of a class, null when there is none."""

    def text(i: str) -> str:
        return f"CASE WHEN {i} >= 0 THEN {tag_text(f'slice({page}, {i} + 1, {_size(page, i)} + 1)', gap)} END"

    return bound(f"CAST(array_position(transform({page}, t -> {_wanted(token, name)} AND NOT t.end), true) AS INT) - 1", text)


def literal(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _decoded(text: str) -> str:
    for mark, reference in reversed(MARKUP.items()):
        text = f"replace({text}, {literal(reference)}, {literal(mark)})"
    return text


def attribute(head: str, name: str) -> str:
    """Attribute value of an opening tag, null when it is absent or empty."""

    def value(found: str) -> str:
        plain = f"CASE WHEN left({found}, 1) IN ({literal(QUOTES[0])}, {literal(QUOTES[1])}) THEN substr({found}, 2, length({found}) - 2) ELSE {found} END"
        return f"nullif({_decoded(plain)}, '')"

    return bound(f"regexp_extract({head}, {literal(_VALUE.format(name=name))}, 1)", value)


QUOTES = "\"'"
_VALUE = r"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _value(head: Column, name: str) -> Column:
    """Value of an attribute as it is written, empty when it is absent."""

    def bare(found: Column) -> Column:
        return F.when(F.substr(found, F.lit(1), F.lit(1)).isin(*QUOTES), F.substr(found, F.lit(2), F.length(found) - 2)).otherwise(found)

    return let(F.regexp_extract(head, _VALUE.format(name=name), 1), bare)


def page_title(page: str, site: str, fallback: Column | None = None) -> Column:
    """First h1, else the title element, of a page's tags; the site suffix is removed."""
    h1, title = (F.expr(first_text(page, "", name, " ")) for name in ("h1", "title"))
    text = F.coalesce(h1, title, fallback if fallback is not None else F.lit(""))
    suffix = r"(?iU)\s*\|\s*" + site.replace(".", r"\.") + r".*$"
    return F.regexp_replace(text, suffix, "") if site else text
