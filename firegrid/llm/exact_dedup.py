"""Exact de-duplication by a two-pass Bloom filter, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import SPACES, checkpoint, fresh, hot_keys, possible_ids, repeat_filter, spread_join


def _digest() -> Column:
    return F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, ""), 256)


def _length() -> Column:
    return F.char_length(F.coalesce("text", F.lit("")))


def copy_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    Texts are equal if they are the same after all white space is deleted; null counts as
    empty, and all empty texts are one group. The longest original text stays, then the
    smallest doc_id (a null id sorts first), then the first of repeated rows. Columns other
    than doc_id and text are ignored; an empty table gives an empty result.

    Rows carry a digest instead of the text. The filter's first pass shuffles two cell
    numbers a row, after partial counts; its second pass shuffles nothing. Digests that it
    finds at most once go straight to the result; only possibly repeated ones are grouped,
    and a digest with very many rows is dealt over several tasks. The filter is at most
    32 MB: beyond its load more rows are grouped, with the same result.
    """
    rows = checkpoint(docs.select("doc_id", _digest().alias("text_sha256"), _length().alias("n"), F.monotonically_increasing_id().alias("row")))
    total = rows.count()
    seen = repeat_filter(rows, "text_sha256", total)
    single = seen.filter(~F.col("maybe_repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    repeated = seen.filter("maybe_repeated")
    groups = checkpoint(
        repeated.groupBy("text_sha256").agg(F.min(F.struct((-F.col("n")).alias("n"), "doc_id", "row")).alias("first"), F.count("*").alias("group_size"))
    )
    hot = hot_keys(groups, "text_sha256", groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0], "group_size")
    grouped = spread_join(repeated, groups, "text_sha256", hot, "row").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )
    return single.unionByName(grouped)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of every group of equal texts exactly one.

    Rows are told apart by their text and length, never by doc_id alone, so rows that share
    an id and differ in text are separate. Texts without a copy pass straight on.
    """
    sha, mark, first = fresh("_sha", docs), fresh("_possible", docs), fresh("_first", docs)
    keyed = docs.withColumn(sha, _digest())
    narrow = checkpoint(docs.select(_digest().alias(sha), F.col("doc_id"), _length().alias(f"{sha}_n")))
    groups = repeat_filter(narrow, sha, narrow.count()).filter("maybe_repeated").groupBy(sha)
    groups = checkpoint(groups.agg(F.min(F.struct((-F.col(f"{sha}_n")).alias("n"), "doc_id")).alias(first), F.count("*").alias("count")).filter("count > 1"))
    hot = hot_keys(groups, sha, groups.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    seen = possible_ids(keyed, groups, sha, mark)
    straight = seen.filter(~F.col(mark)).select(*docs.columns)
    told = spread_join(seen.filter(mark), groups.select(sha, first), sha, hot, "doc_id", "left")
    alone = told.filter(F.col(first).isNull()).select(*docs.columns)
    leading = told.filter(F.col("doc_id").eqNullSafe(F.col(f"{first}.doc_id")) & (_length() == -F.col(f"{first}.n")))
    # Rows that agree in text, id and length are repeats of one row: one of them stays.
    return straight.unionByName(alone).unionByName(leading.dropDuplicates([sha]).select(*docs.columns))
