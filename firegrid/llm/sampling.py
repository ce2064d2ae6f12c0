"""Bounded, repeatable samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, allowed=None) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most `per_class` documents for 0 and for 1, and the counts of both over all labels.

    The rows of each class are those first by a hash of doc_id. Null ids and labels other
    than 0 and 1 are left out; a document labelled twice counts once, with its larger label.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    if allowed is not None:
        known = known.filter(allowed)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id", F.lit(11))
    picked = [known.filter(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    # At most 2 * per_class rows of two integers.
    side = F.broadcast(picked[0].union(picked[1]))
    return docs.select("doc_id", "text").join(side, "doc_id"), counts
