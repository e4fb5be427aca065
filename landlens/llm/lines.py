"""Line dedup by content-defined chunks of lines.

A text is read as units: its lines, and of a line of ``LONG_WORDS`` words or more the sentences it is made of; blank lines belong
to the unit before them. White space at a unit's end is no part of its content.

1. A hash rolls over the hashes of two neighbouring units. Pairs of neighbours (and single units of ``LONG_WORDS`` words) whose hash
   occurs once in all documents can't be inside a repeated passage; the units that are joined by repeated pairs form stretches.
2. A stretch is cut where a pair occurs more or less often than the one before it (the unit between them belongs to both parts),
   and the parts are cut into chunks where the rolling hash says so: boundaries depend on the units beside them alone. A chunk
   has two units or more. In stretches of ``LONG_WORDS`` words also the runs count that go from a unit to the first one that
   brings so many words, or end at a unit and have no shorter one with so many: a repeated passage of ``LONG_WORDS`` words is
   the union of the runs inside it, so it is found whole wherever it stands, whatever its neighbours.
3. Chunks and runs are compared as lists of unit hashes, and the bytes of all units of stretches by grouping on them: a list
   that holds a hash of two different units, or shares 128 bits of hash with another list, is left where it stands.

Spans that occur more than once are removed, but for their first occurrence (smallest doc_id, then place). Everything is
DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.llm.common import table
from landlens.llm.fingerprints import let
from landlens.session import materialise

LONG_WORDS = 50
#: One in so many places is a boundary.
DIVISOR = 3
#: Chunks below this many words are too common to tell copies from chance.
MIN_WORDS = 10
#: Most runs end within so many units; the others are looked for among ``LONG_WORDS`` units, as each has a word.
NEAR_UNITS = 10
NEXT_LINE = r"\n(?=[ \t\r]*[^ \t\r\n])"
#: The first condition spares most places the second one.
NEXT_SENTENCE = r"(?<=\s)(?<=[.!?]\s{1,3})(?=\S)"
SPAN = "array<struct<s:int,n:int,ids:array<bigint>>>"


def words_in(text: Column) -> Column:
    """Number of words; spaces and line ends separate them."""
    return F.size(F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), lambda w: w != ""))


def units(text: Column) -> Column:
    """array<string>: lines, and the sentences of long lines; put together they are the text. Only the first can be blank."""

    def line_units(line: Column) -> Column:
        long = (F.length(line) >= 2 * LONG_WORDS - 1) & (words_in(line) >= LONG_WORDS)
        return F.when(long, F.split(line, NEXT_SENTENCE)).otherwise(F.array(line))

    def ended(pieces: Column) -> Column:
        lines = F.transform(pieces, lambda x, i: F.when(i < F.size(pieces) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
        return F.flatten(F.transform(lines, line_units))

    return let(F.split(F.coalesce(text, F.lit("")), NEXT_LINE), ended)


def content(unit: Column) -> Column:
    """What follows a passage, a space or the end of a line, is no part of it."""
    return F.rtrim(unit, F.lit(" \n\r\t"))


def facts(text: Column) -> Column:
    """array<struct(w, e)>: words and hash of each unit."""
    return F.transform(units(text), lambda x: F.struct(words_in(x).alias("w"), F.xxhash64(content(x)).alias("e")))


def marks(u: Column) -> Column:
    """array<struct(mark, key)>: 2k for units k and k + 1, 2k + 1 for a long unit k, with the hash to be counted."""

    def pair(x: Column, k: Column) -> Column:
        after = F.get(u, k + 1)
        return F.when((x["w"] > 0) & (after["w"] > 0), F.struct((2 * k).alias("mark"), F.xxhash64(x["e"], after["e"]).alias("key")))

    def alone(x: Column, k: Column) -> Column:
        return F.when(x["w"] >= LONG_WORDS, F.struct((2 * k + 1).alias("mark"), F.xxhash64(x["e"]).alias("key")))

    empty = F.array().cast("array<struct<mark:int,key:bigint>>")
    return F.array_compact(F.concat(F.transform(u, pair), F.when(F.exists(u, lambda x: x["w"] >= LONG_WORDS), F.transform(u, alone)).otherwise(empty)))


def stretches(found: Column, alike: bool = False) -> Column:
    """array<struct(a, b)>: first and last units of the stretches, from sorted marks; if ``alike``, of their parts in which all
    pairs occur equally often. Neighbouring parts share a unit."""

    def cut(links: Column) -> Column:
        def joins(i: Column, j: Column) -> Column:
            one, next_one = F.get(links, i), F.get(links, j)
            near = one["mark"] + 2 == next_one["mark"]
            return F.coalesce(near & (one["n"] == next_one["n"]) if alike else near, F.lit(False))

        starts = F.array_compact(F.transform(links, lambda x, i: F.when(~joins(i - 1, i), F.shiftright(x["mark"], 1))))
        ends = F.array_compact(F.transform(links, lambda x, i: F.when(~joins(i, i + 1), F.shiftright(x["mark"], 1) + 1)))
        return let(ends, lambda e: F.transform(starts, lambda a, i: F.struct(a.alias("a"), F.get(e, i).alias("b"))))

    return let(F.filter(found, lambda m: m["mark"] % 2 == 0), cut)


def long_units(found: Column) -> Column:
    return F.transform(F.filter(found, lambda m: m["mark"] % 2 == 1), lambda m: F.shiftright(m["mark"], 1))


def chunks(part: Column) -> Column:
    """array<struct(s, n)>: the chunks of a stretch."""
    size = F.size(part)

    def chosen(j: Column) -> Column:  # is there a boundary between unit j - 1 and unit j?
        return F.pmod(F.xxhash64(F.get(part, j - 1)["e"], F.get(part, j)["e"]), F.lit(DIVISOR)) == 0

    # neighbouring places are not both boundaries, and no unit at an end is left alone
    stops = F.filter(F.sequence(F.lit(2), size), lambda j: (j == size) | ((j <= size - 2) & chosen(j) & ~chosen(j - 1)))

    def one(found: Column) -> Column:
        def chunk(stop: Column, k: Column) -> Column:
            start = F.when(k == 0, 0).otherwise(F.get(found, k - 1))
            return F.struct(start.alias("s"), (stop - start).alias("n"))

        return F.transform(found, chunk)

    def enough(c: Column) -> Column:
        return F.aggregate(F.slice(part, c["s"] + 1, c["n"]), F.lit(0), lambda a, x: a + x["w"]) >= MIN_WORDS

    return F.filter(let(stops, one), enough)


def runs(part: Column) -> Column:
    """array<struct(s, n)>: the runs of ``LONG_WORDS`` words of a stretch, of two units or more."""

    full = LONG_WORDS << 6  # words and units in one number

    def reach(words: Column, k: Column) -> Column:  # the unit with which they are reached from unit k on, or null
        def within(n: int) -> Column:
            total = F.aggregate(F.slice(words, k + 1, n), F.lit(0), lambda a, w: F.when(a < full, a + w).otherwise(a))
            return let(total, lambda t: F.when(t >= full, k + t % 64 - 1))

        return F.coalesce(within(NEAR_UNITS), within(LONG_WORDS))

    def each(m: Column) -> Column:
        def one(end: Column, k: Column) -> Column:
            last = F.greatest(end, F.coalesce(F.get(m, k + 1), F.size(m)) - 1)
            return F.when(end.isNotNull(), F.transform(F.sequence(end, last), lambda e: F.struct(k.alias("s"), (e - k + 1).alias("n"))))

        return F.filter(F.flatten(F.array_compact(F.transform(m, one))), lambda r: r["n"] > 1)

    counts = F.transform(part, lambda x: F.least(x["w"], F.lit(LONG_WORDS)) * 64 + 1)
    return let(let(counts, lambda words: F.transform(words, lambda _, k: reach(words, k))), each)


def spans(u: Column, found: Column) -> Column:
    """SPAN: n units from unit s on, with their hashes; ``found`` are the marks that occur more than once and how often, sorted."""

    def with_ids(part: Column, first: Column, places: Column) -> Column:
        def each(ids: Column) -> Column:
            return F.transform(places, lambda c: F.struct((first + c["s"]).alias("s"), c["n"].alias("n"), F.slice(ids, c["s"] + 1, c["n"]).alias("ids")))

        return let(F.transform(part, lambda x: x["e"]), each).cast(SPAN)

    def inside(body: Callable[[Column], Column], least: int) -> Callable[[Column], Column]:
        def stretch(z: Column) -> Column:
            def read(part: Column) -> Column:
                total = F.aggregate(part, F.lit(0), lambda a, x: a + x["w"])
                return F.when(total >= least, with_ids(part, z["a"], body(part))).otherwise(F.array().cast(SPAN))

            return let(F.slice(u, z["a"] + 1, z["b"] - z["a"] + 1), read)

        return stretch

    alone = F.transform(long_units(found), lambda k: F.struct(k.alias("s"), F.lit(1).alias("n"), F.array(F.get(u, k)["e"]).alias("ids")))
    return F.concat(
        F.flatten(F.transform(stretches(found, alike=True), inside(chunks, MIN_WORDS))), F.flatten(F.transform(stretches(found), inside(runs, LONG_WORDS))), alone.cast(SPAN)
    )


def marked_units(text: Column, found: Column) -> Column:
    """array<string>: contents of the units that spans can hold."""

    def pick(x: Column) -> Column:
        joined = F.flatten(F.transform(stretches(found), lambda z: F.slice(x, z["a"] + 1, z["b"] - z["a"] + 1)))
        return F.transform(F.concat(joined, F.transform(long_units(found), lambda k: F.get(x, k))), content)

    return let(units(text), pick)


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text's hash), drop array<int>: the units (from 0) that go from each document that loses any."""
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("t"), "text")
    read = materialise(docs.select("doc_id", "t", facts(F.col("text")).alias("u")), "line-units")
    seen = read.select("doc_id", "t", F.explode(marks(F.col("u"))).alias("c")).select("doc_id", "t", "c.*")
    # written first, so that the join on a frequent pair's hash can be split
    several = materialise(seen.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "line-several")
    found = seen.join(several, "key").groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("mark", "n"))).alias("found"))
    found = materialise(found, "line-found")
    spread = read.join(found, ["doc_id", "t"]).select("doc_id", "t", F.explode(spans(F.col("u"), F.col("found"))).alias("c")).select("doc_id", "t", "c.*")
    # two hashes of a list stand for it where its copies are looked up
    spread = materialise(spread.withColumns({"h": F.xxhash64("ids"), "g": F.xxhash64(F.lit(1), "ids")}), "line-spans")
    same_hash = docs.join(found, ["doc_id", "t"]).select(F.explode(marked_units(F.col("text"), F.col("found"))).alias("unit")).distinct()
    unlike = materialise(same_hash.groupBy(F.xxhash64("unit").alias("e")).agg(F.count("*").alias("n")).where("n > 1").select("e"), "line-unlike")
    # a place as one number, so that its minimum needs no sort
    base = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)")
    place = base + F.col("s")
    copies = materialise(spread.groupBy("h", "g", "ids").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "ids", "first"), "line-copies")
    wrong = copies.select("h", "g", F.explode("ids").alias("e")).join(unlike, "e", "left_semi").select("h", "g").distinct()
    # lists that share both hashes stay where they are
    copies = copies.groupBy("h", "g").agg(F.min("first").alias("first"), F.count("*").alias("lists")).where("lists = 1").drop("lists").join(wrong, ["h", "g"], "left_anti")
    # written, so that the join on a frequent list's hashes can be split
    copies = materialise(copies, "line-firsts")
    gone = spread.select("h", "g", "doc_id", "t", "s", "n").join(copies, ["h", "g"]).where(place != F.col("first"))
    # a copy that overlaps the first occurrence begins behind it
    start = F.when(F.col("first") >= base, F.greatest("s", (F.col("first") - base).cast("int") + F.col("n"))).otherwise(F.col("s"))
    gone = gone.select("doc_id", "t", start.alias("start"), (F.col("s") + F.col("n") - 1).alias("stop")).where("start <= stop").distinct()
    return gone.groupBy("doc_id", "t").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", "stop")))).alias("drop"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated spans removed from ``text``, and n_dropped (units that went) beside it.

    All rows and other columns stay. Rows with a null doc_id are left as they are; rows with equal doc_ids count as copies of
    each other's place, so equal spans at equal places in them all stay. A null text stays null, an empty one empty.
    """
    drops = repeated(docs).select(F.col("doc_id").alias("__doc"), F.col("t").alias("__t"), F.col("drop").alias("__drop"))
    rows = docs.join(drops, (docs["doc_id"] == F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__t")), "left").drop("__doc", "__t")

    def without(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drop"))
        return F.array_join(F.transform(left, lambda i: F.get(parts, i)), "")

    return rows.withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(let(units(docs["text"]), without))).withColumn(
        "n_dropped", F.coalesce(F.size("__drop"), F.lit(0))
    ).drop("__drop")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_dropped, n_chars and the text that stays."""
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_chars"), "text")
