"""Line dedup by winnowing and by whole stored lines, in DataFrame functions only.

Stored lines (ended by a newline, with at least one word) are hashed whole, and each but the first of equal ones is
deleted, however short it is. Repeated passages need another way: for them a line is any LINE consecutive words of a text
(a rolling line), as passages start and end inside the stored lines, whose own hashes would miss them. Of each WINDOW
consecutive line hashes the smallest (the first of equal ones) is a fingerprint, so wherever two texts share
LEAST = LINE + WINDOW - 1 words in a row they share a fingerprint.

Positions of fingerprints that occur more than once are joined, and matches are extended both ways: a fingerprint's
context are all words that can be in a run of LEAST words with its line, WINDOW - 1 to either side. Where the whole
context has been at an earlier place it is a repeated run. Contexts are grouped, and only the first of each is looked at
further: where a fingerprint has contexts that differ, the extension stops inside some of them, so each run of LEAST words
in these (one a window) is held against all earlier places. Any run of LEAST words is thus either in a context that has
an earlier equal, or is judged by itself; so precisely the words that lie in a run of LEAST words that an earlier place
has too are deleted, whichever texts have the earlier places, and nothing else. Texts are compared by their words as they
stand (96 bits of two hashes over the words' 64-bit hashes); white space may differ.

Places are those of the texts as given, earlier being of smaller id, then smaller position; an earlier place counts even
if it is deleted too: what it holds is then at a place before it. Grouping is by partial sums, and the joins to repeated
fingerprints and first places have one row per hash on one side, so frequent lines are no hot keys. Whole texts are
read once for the fingerprints, once for contexts that differ (texts that have any), and once for the cut.

Cases: a null text stays null and has no words; a text of fewer than LEAST words only has stored lines, blank lines are
none; very long texts are handled by their words' hashes, 8 bytes a word and array; of rows that repeat id and text the first
in row order is kept whole; ids may be null, repeat or be of any type that has an order (rows then count in (id, row)
order); an empty table stays empty; further columns are kept, whatever their names, but one called like `report` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LINE, WINDOW = 16, 32  # words a line (a power of two), lines a window
LEAST = LINE + WINDOW - 1
TINY = 1 << 14  # bytes of a side that is joined to whole texts by broadcast; it grows with the texts, so beyond that both are shuffled
_SEEN = 8  # neighbours that tell most windows apart in which the smallest line stays the same
_POSITIONS = 1 << 31  # more than a text has words
_BLANK = " \t\n\x0b\f\r"  # white space of the regular expressions below


def _words(text: Column) -> Column:
    """The words between white space; splitting at one character is much faster than at a regular expression."""
    rare = r"[\t\x0B\f\r]"
    flat = F.when(F.rlike(text, F.lit(rare)), F.regexp_replace(text, rare, " ")).otherwise(text)
    return F.array_remove(F.split(F.replace(flat, F.lit("\n"), F.lit(" ")), " "), "")


def _hashed(own: DataFrame, *columns: str) -> DataFrame:
    return own.select("__key", *columns, F.transform(_words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))


def fingerprints(own: DataFrame, line: int = LINE, window: int = WINDOW) -> DataFrame:
    """(__key, i, p, fp, c, d): the lines at p that are the smallest of a window, from the window at i on, of texts (__key, text).

    fp is the line's hash; c and d are of its context. Lambdas over arrays are slow, so they only make the hashes; windows are
    looked at in generated code, one row each. Arrays that a lambda reads are columns of an earlier projection, to which each is
    a column that is used twice, or else the optimiser would put their making into the lambda's expression.
    """
    if line & (line - 1) or line < 2 or window < 2:
        raise ValueError("line must be a power of two, window at least two")
    rows = _hashed(own).select("__key", "h", F.col("h").alias("m"))
    by = 1
    while by < line:  # hashes of twice as many words: word j of a line enters moved by j bits, which is much faster than hashing anew
        rows = rows.withColumn("s", F.slice("m", by + 1, F.greatest(F.size("m") - by, F.lit(0))))
        pairs = F.zip_with("m", "s", lambda x, y: x.bitwiseXOR(F.shiftleft(y, by)))  # noqa: B023
        rows = rows.select("__key", "h", F.when(F.size("s") >= 0, pairs).alias("m"))
        by *= 2
    starts = F.when(F.size("h") >= line + window - 1, F.sequence(F.lit(0), F.size("h") - (line + window - 1)))
    rows = rows.select("__key", "h", "m", F.explode(starts).alias("i"))
    at = lambda j: F.get("m", F.col("i") + j)
    # the smallest line is another than a window before only if the new line is the smallest or the one that left was
    near = range(min(_SEEN, window - 1))
    new, old = F.lit(True), F.lit(True)
    for j in near:
        new, old = new & (at(window - 1) < at(window - 2 - j)), old & (at(-1) <= at(j))
    rows = rows.filter((F.col("i") == 0) | new | old)
    # each value is the one element of an array exploded, which filters and later projections read instead of making it again
    one = lambda x: F.explode(F.array(x))
    rows = rows.select("__key", "h", "m", "i", one(F.slice("m", F.col("i") + 1, window)).alias("w"))
    rows = rows.select("__key", "h", "m", "i", "w", one(F.array_min("w")).alias("fp"))
    rows = rows.filter((F.col("i") == 0) | (F.col("fp") == at(window - 1)) | (at(-1) <= F.col("fp")))
    place = F.array_position("w", F.col("fp")).cast("int")
    rows = rows.select("__key", "h", "i", (F.col("i") + place - 1).alias("p"), "fp")
    low = F.greatest(F.col("p") - window + 1, F.lit(0))
    rows = rows.select("__key", "i", "p", "fp", (F.col("p") - low).alias("o"), one(F.slice("h", low + 1, F.col("p") + line + window - 1 - low)).alias("x"))
    return rows.select("__key", "i", "p", "fp", F.xxhash64("o", "x").alias("c"), F.hash("x").alias("d"))


def small_keys(own: DataFrame, window: int = WINDOW) -> bool:
    """Whether the keys of own (__key, ..) are so small that a key, a position and a step of a window fit one long."""
    low, high = own.agg(F.min("__key"), F.max("__key")).first()
    return low is None or max(-low, high) < _POSITIONS * 2 // window


def firsts(found: DataFrame, on: list[str], small: bool, window: int = 1) -> DataFrame:
    """(on, at {__key, p, i}, n): of the rows of found (on, __key, p, i) equal in `on` the first place and the number; i is from p - window + 1 to p.

    Structs are aggregated by sorting, longs by hashing, which is faster; so where the keys are small a place is one long."""
    if not small:
        return found.groupBy(*on).agg(F.min(F.struct("__key", "p", "i")).alias("at"), F.count(F.lit(1)).alias("n"))
    place = (F.col("__key") * _POSITIONS + F.col("p")) * window + (F.col("i") - F.col("p") + (window - 1))
    rows = found.groupBy(*on).agg(F.min(place).alias("x"), F.count(F.lit(1)).alias("n"))
    floor = lambda x, by: F.call_function("div", x - F.pmod(x, F.lit(by).cast("long")), F.lit(by).cast("long"))
    text = floor(F.col("x"), window)
    p = F.pmod(text, F.lit(_POSITIONS)).cast("int")
    i = p + F.pmod(F.col("x"), F.lit(window).cast("long")).cast("int") - (window - 1)
    return rows.select(*on, F.struct(floor(text, _POSITIONS).alias("__key"), p.alias("p"), i.alias("i")).alias("at"), "n")


def later(found: DataFrame, on: list[str], small: bool) -> DataFrame:
    """(__key, pos) of the rows of the staged table found (on, __key, pos) but the first of those equal in `on`."""
    first = firsts(found.select(*on, "__key", F.col("pos").alias("p"), F.col("pos").alias("i")), on, small).filter("n > 1")
    first = common.staged(first.select(*on, F.col("at.__key").alias("src"), F.col("at.p").alias("at")), "first", dictionary=False)
    return found.join(first.hint("merge"), on).filter("__key <> src or pos <> at").select("__key", "pos")


def runs_at(own: DataFrame, places: DataFrame, line: int, window: int) -> DataFrame:
    """(w, v, __key, pos): two hashes of the runs of line + window - 1 words of texts (__key, text) that start in places (__key, at),
    `at` being arrays of {i, p}: starts from i to p."""
    least = line + window - 1
    rows = _hashed(common.join_sized(own, places, ["__key"], "inner", TINY), "at")
    none = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("p"))
    rows = rows.select("__key", "h", F.explode(F.arrays_zip(F.col("at"), F.concat(F.array(none), F.slice("at", 1, F.size("at") - 1)).alias("last"))).alias("x"))
    low, high = F.greatest("x.at.i", F.col("x.last.p") + 1), F.least(F.col("x.at.p"), F.size("h") - least)  # each start once
    rows = rows.select("__key", "h", F.explode(F.when(low <= high, F.sequence(low, high))).alias("pos"))
    run = F.slice("h", F.col("pos") + 1, least)
    return rows.select(F.xxhash64(run).alias("w"), F.hash(run).alias("v"), "__key", "pos")


def repeats(own: DataFrame, line: int = LINE, window: int = WINDOW) -> DataFrame:
    """(__key, runs): for texts (__key, text) the words that lie in runs of line + window - 1 words that an earlier place has too."""
    least, small = line + window - 1, small_keys(own, window)
    found = common.staged(fingerprints(own, line, window), "fingerprints", dictionary=False)
    # staged, so that the join below has plain exchanges on both sides and a hot fingerprint can be split
    often = common.staged(found.groupBy("fp").count().filter("count > 1").select("fp"), "often", dictionary=False)
    near = common.staged(found.join(often.hint("merge"), "fp"), "near", dictionary=False)
    common.release(found, often)
    same = ["fp", "c", "d"]
    first = common.staged(firsts(near, same, small, window), "contexts", dictionary=False)
    again = near.join(first.filter("n > 1").hint("merge"), same).filter("__key <> at.__key or p <> at.p")
    again = again.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct(F.greatest(F.col("p") - window + 1, F.lit(0)).alias("start"), (F.col("p") + least).alias("end")))).alias("runs"))
    again = common.staged(again.select("__key", _joined(F.col("runs")).alias("runs")), "again")
    common.release(near)
    differ = common.staged(first.groupBy("fp").count().filter("count > 1").select("fp"), "differ")
    open_ = first.join(differ.hint("merge"), "fp").select("at.__key", "at.i", "at.p")
    open_ = common.staged(open_.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("i", "p"))).alias("at")), "open")
    common.release(first, differ)
    judged = common.staged(runs_at(own, open_, line, window), "runs", dictionary=False)
    rows = later(judged, ["w", "v"], small).groupBy("__key").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    rows = rows.select("__key", _joined(F.transform("at", lambda p: F.struct(p.alias("start"), (p + least).alias("end")))).alias("more"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    both = rows.join(again, "__key", "full").select("__key", _merged(F.array_sort(F.concat(F.coalesce("runs", none), F.coalesce("more", none)))).alias("runs"))
    out = common.staged(both, "repeats")
    common.release(again, open_, judged)
    return out


def _joined(runs: Column) -> Column:
    """Sorted runs, none of which lies inside another, with those that overlap or touch made one, in one pass."""
    pairs = F.zip_with(runs, F.slice(runs, 2, F.size(runs)), lambda a, b: F.struct(a.end.alias("end"), b.start.alias("start")))
    gaps = F.filter(pairs, lambda p: p.start > p.end)
    starts = F.concat(F.transform(F.slice(runs, 1, 1), lambda r: r.start), F.transform(gaps, lambda g: g.start))
    ends = F.concat(F.transform(gaps, lambda g: g.end), F.transform(F.slice(runs, -1, 1), lambda r: r.end))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def _merged(runs: Column) -> Column:
    """Sorted runs with those that overlap or touch made one."""

    def put(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last.start.alias("start"), F.greatest(last.end, r.end).alias("end"))
        return F.when(r.start <= last.end, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(runs, F.array().cast("array<struct<start:int,end:int>>"), put)


def repeated_lines(own: DataFrame) -> DataFrame:
    """(__key, lines): for texts (__key, text) the numbers of the stored lines with words that an earlier place has too. Lines are
    equal if their text is, white space at the ends and the kind of single blanks aside."""
    flat = F.when(F.rlike("text", F.lit(r"[\t\x0B\f\r]")), F.regexp_replace("text", r"[\t\x0B\f\r]", " ")).otherwise(F.col("text"))
    lines = F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = own.select("__key", F.posexplode(lines).alias("pos", "l"))
    found = common.staged(rows.select(F.xxhash64("l").alias("h"), F.hash("l").alias("g"), "__key", "pos"), "lines", dictionary=False)
    out = later(found, ["h", "g"], small_keys(own)).groupBy("__key").agg(F.sort_array(F.collect_list("pos")).alias("lines"))
    out = common.staged(out, "later-lines")
    common.release(found)
    return out


@common.owned
def cut_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line: int = LINE, window: int = WINDOW, report: str = "__cut"
) -> DataFrame:
    """docs with later repeated runs deleted from the text, plus `report`: {removed (words), emptied (no word is left of some)}."""
    keyed = common.row_keyed(docs, id_col, text_col)
    own = keyed.select("__key", "text")
    runs, lines = repeats(own, line, window), repeated_lines(own)
    found = common.staged(runs.join(lines, "__key", "full"), "found")
    common.release(runs, lines)
    rows = common.join_sized(keyed.select("__key", "row"), found, ["__key"], "left", TINY)  # the text is in the row, and sent once
    rows = rows.withColumn("text", F.col("row").getField(text_col).cast("string"))
    # words, or where only stored lines go these, with the white space after them; what is left are the slices between cuts
    spaced = lambda unit: F.regexp_extract_all(F.ltrim("text", F.lit(_BLANK)), F.lit(unit), F.lit(0))
    # the row number is never negative. Naming it keeps the optimiser from moving filters on the result below these projections, where it
    # would put the making of arrays inside the lambdas, and so repeat it for every word they look at
    named = F.monotonically_increasing_id() >= 0
    by_line = F.col("runs").isNull() & F.col("lines").isNotNull()
    rows = rows.withColumn("kept", F.when(named & by_line, spaced(r"\S[^\n]*(?:\n\s*)?")).when(named & F.col("runs").isNotNull(), spaced(r"\S+\s*")))
    breaks = F.transform("kept", lambda x, i: F.when(F.contains(x, F.lit("\n")), i + 1))
    rows = rows.withColumn("breaks", F.when(F.col("runs").isNotNull() & F.col("lines").isNotNull(), F.filter(breaks, lambda i: i.isNotNull())))
    whole = F.when(by_line, F.transform("lines", lambda n: F.struct(n.alias("start"), (n + 1).alias("end")))).otherwise(F.transform("lines", lambda n: F.struct(
        F.when(n > 0, F.get("breaks", n - 1)).otherwise(0).alias("start"), F.coalesce(F.get("breaks", n), F.size("kept")).alias("end"),
    )))
    none = F.array().cast("array<struct<start:int,end:int>>")
    inside = F.transform("runs", lambda r: F.struct(r.start.alias("start"), F.least(r.end, F.size("kept")).alias("end")))
    cut = _merged(F.array_sort(F.concat(F.coalesce(inside, none), F.coalesce(_joined(whole), none))))
    rows = rows.withColumn("cut", F.when(named, cut))
    rows = rows.withColumn("gone", F.aggregate("cut", F.lit(0), lambda n, r: n + r.end - r.start))
    ends = F.concat(F.array(F.lit(0)), F.transform("cut", lambda r: r.end))
    starts = F.concat(F.transform("cut", lambda r: r.start), F.array(F.size("kept")))
    left = F.zip_with(ends, starts, lambda a, b: F.array_join(F.slice("kept", a + 1, F.greatest(b - a, F.lit(0))), ""))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join(left, ""))
    lost = F.array_join(F.transform("cut", lambda r: F.array_join(F.slice("kept", r.start + 1, r.end - r.start), "")), "")
    rows = rows.withColumn("words", F.when(by_line, F.size(_words(lost))).otherwise(F.coalesce("gone", F.lit(0))))
    names = [c for c in docs.columns if c.lower() != report.lower()]
    return rows.select(
        *(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names),
        F.struct(
            F.col("words").cast("long").alias("removed"), F.coalesce((F.col("gone") > 0) & (F.col("gone") >= F.size("kept")), F.lit(False)).alias("emptied")
        ).alias(report),
    )


@common.owned
def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(common.table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("__cut.removed").alias("n_removed"), F.col("__cut.emptied").alias("emptied"), "text")
