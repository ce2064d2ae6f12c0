"""Secret scans with a trigram index.

Each rule's regex is parsed, and the trigrams that every match must hold are derived as a
Boolean query: any of several alternatives, each of which is a set of trigrams, of which
the rarest are posted. Postings
are bit maps over hashed document ids: of one trigram and one bucket of ids a 4 KB map.
Alternatives intersect their postings, rules unite their alternatives, and only documents
in a rule's map are searched with its regex; a hash collision costs a search and changes
nothing. Rules without mandatory trigrams search every text. DataFrame functions only.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import bit_is_set, checkpoint, filter_bits


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0  # the group that must have `least` characters
    least: int = 1
    any_case: bool = False


#: In the order in which spans that start together are listed; the first three are the base.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("github", r"ghp_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
BASE = 3
#: Trigrams of a clause that are posted: its rarest ones, which bound the matches from above as all of them do.
POSTED = 2
#: Letters of running text, most frequent first.
_FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def _runs(items) -> list[tuple[list[str], str, str, bool]]:
    """Alternatives of a parsed sequence: (finished literal runs, open first run, open last run, whether all is literal)."""
    out = [([], "", "", True)]

    def broken(done, first, last, whole):
        return ([*done, *([] if whole else [last])], first, "", False)

    for op, value in items:
        if op is sre.LITERAL:
            out = [(d, f + chr(value) if w else f, last + chr(value), w) for d, f, last, w in out]
            continue
        if op is sre.SUBPATTERN:
            inner = _runs(value[-1])
        elif op is sre.BRANCH:
            inner = [x for branch in value[1] for x in _runs(branch)]
        elif op is sre.MAX_REPEAT and value[0] >= 1:
            # What is repeated occurs once at least; where it stands is left open.
            inner = [broken(*x) if value[1] > 1 else x for x in _runs(value[2])] if value[1] == 1 else [([*d, f, last], "", "", False) for d, f, last, _ in _runs(value[2])]
        else:
            out = [broken(*x) for x in out]
            continue
        joined = []
        for done, first, last, whole in out:
            for d, f, tail, w in inner:
                if w:
                    joined.append((done, first + f if whole else first, last + f, whole))
                else:
                    joined.append(([*done, *([] if whole else [last + f]), *d], first + f if whole else first, tail, False))
        out = joined
    return out


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """Alternatives of which one must hold with all its lower-cased trigrams; empty: no mandatory trigrams."""
    out = set()
    for done, first, last, whole in _runs(parser.parse(rule.regex)):
        runs = [first] if whole else [*done, first, last]
        grams = frozenset(r[i : i + 3].lower() for r in runs for i in range(len(r) - 2))
        if not grams:
            return []
        out.add(grams)
    return sorted(out, key=sorted)


def posted_query(rule: Rule) -> list[frozenset[str]]:
    """trigram_query() with the POSTED rarest trigrams of each alternative; anything but letters counts as rare."""
    rarity = lambda g: (-sum(_FREQUENT.index(c) if c in _FREQUENT else len(_FREQUENT) for c in g), g)
    return sorted({frozenset(sorted(clause, key=rarity)[:POSTED]) for clause in trigram_query(rule)}, key=sorted)


def _pattern(rule: Rule) -> str:
    return f"(?i:{rule.regex.split(')', 1)[0]})){rule.regex.split(')', 1)[1]}" if rule.any_case else rule.regex


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """(start, kind number, end) of the rule's leftmost non-overlapping matches, in code points.

    The pieces between the matches and the matches themselves give the places.
    """
    pattern = _pattern(rule)
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    part = F.regexp_extract_all(text, F.lit(pattern), rule.group)
    zipped = F.arrays_zip(F.slice(F.transform(pieces, F.char_length), 1, F.size(whole)).alias("gap"), F.transform(whole, F.char_length).alias("n"), F.transform(part, F.char_length).alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["n"]
        span = F.array(F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(zipped, start, step, lambda s: s["spans"])


def candidate_maps(docs: DataFrame, cell: Column, rules=RULES) -> DataFrame | None:
    """(bucket, rule_0, ...): for every indexed rule the bit map of the document cells that may match.

    One pass over the texts finds the trigrams of the queries; a row of ids and trigram
    numbers is shuffled by bucket, never the text.
    """
    spark = docs.sparkSession
    asked = {k: q for k, rule in enumerate(rules) if (q := posted_query(rule))}
    if not asked:
        return None
    grams = sorted({g for q in asked.values() for clause in q for g in clause})
    clauses = spark.createDataFrame(
        [(grams.index(g), k, c, len(clause)) for k, q in asked.items() for c, clause in enumerate(q) for g in clause], "gram int, rule int, clause int, needed int"
    )
    lowered = docs.select(cell.alias("cell"), F.lower("text").alias("low"))
    posted = (
        lowered.select("cell", F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(n)) for n, g in enumerate(grams)))).alias("found"))
        .filter("size(found) > 0")
        .select(F.bitmap_bucket_number("cell").alias("bucket"), F.bitmap_bit_position("cell").alias("at"), "found")
        .repartition("bucket")
    )
    postings = posted.select("bucket", "at", F.explode("found").alias("gram")).groupBy("bucket", "gram").agg(F.bitmap_construct_agg("at").alias("bits"))
    # The clauses are a fixed short list of the rules.
    met = (
        postings.join(F.broadcast(clauses), "gram")
        .groupBy("bucket", "rule", "clause", "needed")
        .agg(F.expr("bitmap_and_agg(bits)").alias("bits"), F.count("*").alias("n"))
        .filter("n = needed")
        .groupBy("bucket", "rule")
        .agg(F.bitmap_or_agg("bits").alias("bits"))
    )
    return met.groupBy("bucket").agg(*(F.first(F.when(F.col("rule") == k, F.col("bits")), ignorenulls=True).alias(f"rule_{k}") for k in asked))


def _cell(docs: DataFrame) -> Column:
    """The hashed place of a document's id among 2 to 32 times the rows, 2**26 places at most."""
    bits = min(1 << 26, filter_bits(docs.count(), 4))
    return F.xxhash64(F.col("doc_id"), F.lit(5)).bitwiseAND(F.lit(bits - 1))


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and spans (start, kind, end), sorted, of every row of `docs`; end is exclusive.

    kind is the rule's number. Null texts count as empty. Repeated rows and null ids keep
    a row each; other columns are ignored.
    """
    cell = _cell(docs)
    maps = candidate_maps(docs, cell, rules)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), cell.alias("_cell"))
    indexed = set()
    if maps is not None:
        maps = checkpoint(maps)
        indexed = {int(c.split("_")[1]) for c in maps.columns if c != "bucket"}
        # At most 2**26 bits a rule: 8 MB.
        rows = rows.withColumn("_bucket", F.bitmap_bucket_number("_cell")).join(F.broadcast(maps.withColumnRenamed("bucket", "_bucket")), "_bucket", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for k, rule in enumerate(rules):
        may = bit_is_set(F.col(f"rule_{k}"), F.col("_cell")) if k in indexed else F.col("text").rlike(_pattern(rule))
        found.append(F.when(may, _spans(F.col("text"), k, rule)).otherwise(none).alias(f"spans_{k}"))
    each = rows.select("doc_id", *found)
    return each.select("doc_id", F.array_sort(F.concat(*(F.col(f"spans_{k}") for k in range(len(rules))))).alias("spans"))


def secret_report(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans as text."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))

    def listed(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")

    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan_secrets(docs, rules).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
