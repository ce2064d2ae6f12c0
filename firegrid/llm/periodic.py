"""Periodic runs of words, found in linear time over an ordered alphabet.

Words are letters, known by their rank. For both orders of the alphabet the Lyndon array is
computed from left to right, with the length of the match between each suffix and its next
smaller one. A match that reaches further right than all before is kept as a window: within
it the text repeats, so later matches are read off those found one shift earlier and go on
only at the window's end. Along a chain of smaller suffixes, matches follow from their
neighbours'. So letters are compared a constant number of times each, and neither suffix
structures nor hashes are needed. Every run has a Lyndon root in one of the orders: its
match gives the run's end, and the first root's left extension, shorter than a period, its start.

Runs of `exponent` periods hold each of their words that often, so words that occur less
often in a stretch of text cut it before the search; no run is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import WORD, bound_arrow_batches

#: Rounds of cutting; any number is exact, more leave less to search.
CUT_ROUNDS = 6


def lyndon_array(letters) -> tuple[list[int], list[int]]:
    """(following, match): the start of the next smaller suffix of every suffix, and how far both agree.

    The end of the text is smaller than any letter; where no suffix is smaller, `following` is
    the text's length and the match 0.
    """
    n = len(letters)
    following, match = [n] * n, [0] * n
    before, back = [-1] * n, [0] * n  # the previous smaller suffix, and how far it agrees
    # The window letters[start:end] repeats what stands `shift` earlier; no match ends further right.
    start = end = shift = 0
    for j in range(1, n):
        i, popped, agreed = j - 1, -1, 0
        while i >= 0:
            size, open_ = -1, True
            if i >= start and j < end:
                x, y = i - shift, j - shift
                if following[x] == y:
                    size = match[x]
                elif before[y] == x:
                    size = back[y]
                if size >= end - j:
                    size = end - j
                elif size >= 0:
                    open_ = False
            if size < 0:
                if popped < 0:
                    size = 0
                elif back[popped] == agreed:
                    size = agreed
                else:
                    size, open_ = min(back[popped], agreed), False
            if open_:
                while j + size < n and letters[i + size] == letters[j + size]:
                    size += 1
                if j + size > end:
                    start, end, shift = j, j + size, j - i
            if j + size < n and letters[i + size] < letters[j + size]:
                before[j], back[j] = i, size
                break
            following[i], match[i] = j, size
            popped, agreed, i = i, size, before[i]
    return following, match


def find_runs(letters: list[int], exponent: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of `exponent` (2 or more) smallest periods and `least` letters, by start, then period."""
    n = len(letters)
    found = set()
    top = max(letters, default=0)
    for order in (letters, [top - x for x in letters]):
        following, match = map(np.array, lyndon_array(order))
        period = following - np.arange(n)
        # A first root starts less than a period after its run.
        for i in np.flatnonzero((following < n) & (match + 2 * period - 1 >= np.maximum(least, exponent * period))).tolist():
            p, j = int(period[i]), int(following[i])
            if i >= p and following[i - p] == i and match[i - p] >= p:
                continue  # an earlier root of the same run
            left = 0
            while left < i and order[i - 1 - left] == order[j - 1 - left]:
                left += 1
            length = left + p + int(match[i])
            if length >= max(least, exponent * p):
                found.add((i - left, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(letters: np.ndarray, texts: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of consecutive letters of one text that may hold a run.

    A run of `exponent` periods holds each of its letters that often. Letters that are rarer in
    their stretch lie in no run and cut it.
    """
    at, part = np.arange(len(letters)), texts.astype(np.int64)
    width = int(letters.max(initial=0)) + 1
    for _ in range(CUT_ROUNDS):
        if not len(at):
            break
        _, place, count = np.unique(part * width + letters[at], return_inverse=True, return_counts=True)
        keep = count[place] >= exponent
        if keep.all():
            break
        at, part = at[keep], part[keep]
        if len(at):  # what is no longer consecutive is another stretch
            part = np.cumsum(np.concatenate([[0], (np.diff(at) > 1) | (np.diff(part) != 0)])).astype(np.int64)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(part) != 0)) + 1
    bounds = zip(at[np.concatenate([[0], cut])].tolist(), (at[np.concatenate([cut - 1, [len(at) - 1]])] + 1).tolist(), strict=True)
    return [(a, b) for a, b in bounds if b - a >= max(least, exponent)]


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """doc_id, runs and collapsed of every row of `docs`.

    runs: array<struct<start,length,period>>, by start, then period, of the maximal stretches of
    at least `least` words and `exponent` times their smallest period; words are numbered from 0.
    collapsed: the words joined by one space, without those that any run holds after its first
    period. Null texts have no words. Rows that repeat a doc_id and rows without one keep a row
    each; other columns are ignored.
    """
    bound_arrow_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def kernel(batches):
        for batch in batches:
            split = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
            words, ends = split.flatten(), split.offsets.to_numpy()
            real = pc.greater(pc.binary_length(words), 0)
            kept_before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
            bounds, words = kept_before[ends - ends[0]], words.filter(real)
            texts = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            coded = words.dictionary_encode()
            rank = np.empty(len(coded.dictionary), np.int64)
            rank[pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()] = np.arange(len(rank))
            letters = rank[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
            runs = [[] for _ in range(batch.num_rows)]
            edge = np.zeros(len(letters) + 1, np.int64)
            for a, b in stretches(letters, texts, exponent, least):
                row = int(texts[a])
                for start, length, period in find_runs(letters[a:b].tolist(), exponent, least):
                    runs[row].append({"start": a + start - int(bounds[row]), "length": length, "period": period})
                    edge[a + start + period] += 1
                    edge[a + start + length] -= 1
            left = np.cumsum(edge)[:-1] == 0
            sizes = np.concatenate([[0], np.cumsum(left)])[bounds]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), words.filter(pa.array(left))), " ")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, kind), collapsed], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(kernel, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, with a period planted in the texts of one id in ten, by the id's CRC-32.

    With h = crc32(doc_id), g = h div 10 and n words: if h is divisible by 10, the words from
    a = g mod n on repeat the 1 + (n - a) div (3 + g mod 8) words from there. Rows without an
    id or a word keep their text.
    """
    told = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = told.select("doc_id", "text", "h", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("w"))
    g, n = F.expr("h div 10"), F.size("w")
    placed = words.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.expr("(size(w) - a) div (3 + (h div 10) % 8)")).cast("int"))
    rest = n - F.col("a")
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), repeated), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256 of every row.

    Of runs of one length the first counts, then that of the smallest period; without a run
    the four figures are null. Rows are as in periodic_runs.
    """
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("small"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = periodic_runs(docs).select("doc_id", "runs", F.sha2("collapsed", 256).alias("collapsed_sha256")).withColumn("most", most)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("most.back")).alias("start"), F.col("most.length").alias("length"), (-F.col("most.small")).alias("period"),
        F.expr("(1000 * most.length) div (-most.small)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256",
    )
