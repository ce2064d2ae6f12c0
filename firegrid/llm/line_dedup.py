"""Line de-duplication by winnowing over line hashes, in DataFrame functions only.

A repeated unit is RUN_LINES consecutive lines, or one line of LONG_LINE words or more, or
two consecutive lines with LONG_LINE words or more in sum, that stood earlier, by doc_id
and place. Of every window of RUN_LINES lines, and of every such pair, the smallest line
hash is a fingerprint, so a repeated run always repeats a fingerprint. Fingerprints
that occur once are ruled out by a bounded filter. The units around the others are seeds:
each is joined with the position where its content first stood. A seed is extended both
ways along its diagonal, that is as long as the units before and after it stood before and
after that first position too, and the later runs are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.llm.common import WORD, checkpoint, fresh, hot_keys, possible_ids, repeat_filter, spread_join

RUN_LINES = 3
LONG_LINE = 50
_WHITE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    """The lines that hold a word: number, two hashes of the trimmed line, and its words."""

    def described(line: Column, at: Column) -> Column:
        body = F.btrim(line, F.lit(_WHITE))
        return F.when(body != "", F.struct(at.alias("at"), F.xxhash64(body).alias("h"), F.xxhash64(body, F.lit(3)).alias("g"), F.regexp_count(body, F.lit(WORD)).alias("n")))

    return F.array_compact(F.transform(F.split(text, "\n", -1), described))


def _minimum(lines: Column, start: Column, run: int) -> Column:
    """The place of the last smallest hash in the window that begins at `start`."""
    own = [F.struct(F.get(lines, start + j)["h"].alias("h"), (-(start + j)).alias("back")) for j in range(run)]
    return F.least(*own) if run > 1 else own[0]


def _let(value: Column, body) -> Column:
    """body(x) with x evaluated once, however often a lambda inside the body looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_units(docs: DataFrame, run: int = RUN_LINES) -> tuple[DataFrame, DataFrame]:
    """(lines, units): the lines of every row, and (doc_id, start, size, first_doc, first_start) of every later repeated unit.

    start counts lines with a word. Rows with a null id or a null text have no units.
    """
    lines = checkpoint(docs.select("doc_id", _lines(F.coalesce("text", F.lit(""))).alias("lines")))
    known = lines.filter("doc_id is not null")
    windows = F.when(
        F.size("lines") >= run,
        F.transform(F.sequence(F.lit(0), F.size("lines") - run), lambda s: F.struct(s.alias("start"), (-_minimum(F.col("lines"), s, run)["back"]).alias("mark"))),
    ).otherwise(F.array().cast("array<struct<start:int,mark:int>>"))
    long = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), x["n"].alias("n"))), lambda x: x["n"] >= LONG_LINE)
    # The last line has no next one: its sum is null and is filtered out.
    wordy = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), (x["n"] + F.get(F.col("lines"), i + 1)["n"]).alias("n"))), lambda x: x["n"] >= LONG_LINE)
    pairs = F.transform(wordy, lambda x: F.struct(x["at"].alias("start"), (-_minimum(F.col("lines"), x["at"], 2)["back"]).alias("mark")))
    places = F.array_distinct(F.concat(F.transform(windows, lambda w: w["mark"]), F.transform(pairs, lambda p: p["mark"]), F.transform(long, lambda x: x["at"])))
    prints = known.select("doc_id", F.explode(F.transform(places, lambda p: F.struct(p.alias("mark"), F.get(F.col("lines"), p)["h"].alias("h")))).alias("p")).select("doc_id", "p.*")
    prints = checkpoint(prints)
    hit = repeat_filter(prints, "h", prints.count()).filter("maybe_repeated").groupBy("doc_id").agg(F.collect_set("mark").alias("marks"))
    around = known.join(hit, "doc_id")
    line = lambda k: F.get(F.col("lines"), k)

    def unit(start: Column, size: int) -> Column:
        own = [line(start + j) for j in range(size)]
        return F.struct(start.alias("start"), F.lit(size).alias("size"), F.struct(F.xxhash64(*(x["h"] for x in own)).alias("k1"), F.xxhash64(*(x["g"] for x in own)).alias("k2"), F.lit(size).alias("n")).alias("key"))

    # The units around a mark start no further before it than their size, so each mark looks at those few.
    last = F.size("lines")

    def around_mark(place: Column) -> Column:
        wordy_at = lambda s: (s >= 0) & (s + 1 < last) & (line(s)["n"] + line(s + 1)["n"] >= LONG_LINE)
        of_windows = [F.when((s >= 0) & (s + run <= last) & (-_minimum(F.col("lines"), s, run)["back"] == place), unit(s, run)) for s in (place - k for k in range(run))]
        of_pairs = [F.when(wordy_at(s) & (-_minimum(F.col("lines"), s, 2)["back"] == place), unit(s, 2)) for s in (place - 1, place)]
        return F.array_compact(F.array(*of_windows, *of_pairs, F.when(line(place)["n"] >= LONG_LINE, unit(place, 1))))

    around = around.select("doc_id", F.explode(F.flatten(F.transform("marks", around_mark))).alias("u"))
    units = checkpoint(around.select("doc_id", "u.*").distinct())
    # Only the first position of each content is joined, never all pairs of positions.
    firsts = checkpoint(units.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("count")).filter("count > 1"))
    hot = hot_keys(firsts, "key", firsts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    placed = units.withColumn("place", F.struct("doc_id", "start"))
    later = spread_join(placed, firsts.drop("count"), "key", hot, "place").filter("place <> first")
    return lines, later.select("doc_id", "start", "size", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))


def repeated_runs(units: DataFrame) -> DataFrame:
    """(doc_id, runs): of every row with later repeated units the maximal runs (start, end, first_doc, first_start), by start.

    A run is a chain of seeds on one diagonal (first document, distance of the places) that
    touch or overlap: a seed extends the run of those before it unless it starts beyond all
    their ends. A window holds the seeds of one diagonal of one document.
    """
    seeds = units.select("doc_id", "first_doc", (F.col("first_start") - F.col("start")).alias("shift"), "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    diagonal = Window.partitionBy("doc_id", "first_doc", "shift").orderBy("start", "end")
    reached = F.max("end").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    begun = seeds.withColumn("begins", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0))
    numbered = begun.withColumn("run", F.sum("begins").over(diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("doc_id", "first_doc", "shift", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    named = F.struct("start", "end", "first_doc", (F.col("start") + F.col("shift")).alias("first_start"))
    return runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(named)).alias("runs"))


def drop_repeated_lines(docs: DataFrame, run: int = RUN_LINES) -> DataFrame:
    """`docs` with all its columns, its text without the later repeated runs, and `_removed`.

    _removed (with underscores after it where `docs` has such a column) holds the numbers (from
    0, by \\n) of the deleted lines. Empty and blank lines are never deleted; null texts stay
    null. Rows that repeat a doc_id share its decision, so the first occurrence of a line is
    never lost. Rows with a null id stay as they are.
    """
    removed, mark = fresh("_removed", docs), fresh("_possible", docs)
    lines, units = repeated_units(docs, run)
    gone = repeated_runs(units).select("doc_id", F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["start"], x["end"] - 1)))).alias("places"))
    numbers = checkpoint(
        lines.join(gone, "doc_id").groupBy("doc_id").agg(F.first(F.array_sort(F.array_compact(F.transform("places", lambda p: F.get(F.col("lines"), p)["at"])))).alias(removed))
    )
    seen = possible_ids(docs, numbers, "doc_id", mark)
    none = F.array().cast("array<int>")
    straight = seen.filter(~F.col(mark)).withColumn(removed, none)
    hit = seen.filter(mark).join(numbers, "doc_id", "left").withColumn(removed, F.coalesce(removed, none))
    left = _let(
        F.split("text", "\n", -1),
        lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(removed)), lambda i: F.get(x, i)), "\n"),
    )
    hit = hit.withColumn("text", F.when(F.size(removed) > 0, left).otherwise(F.col("text")))
    return straight.select(*docs.columns, removed).unionByName(hit.select(*docs.columns, removed))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, removed_lines and kept_sha256 of every row."""
    return drop_repeated_lines(docs.select("doc_id", "text")).select(
        "doc_id", F.size("_removed").cast("long").alias("n_removed"), F.array_join(F.col("_removed").cast("array<string>"), ",").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
