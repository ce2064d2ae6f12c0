"""Alignment of two tokenizers against a per-document brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firegrid.llm import alignment
from tests.llm.test_filters import DOCS, documents

PATHS = alignment.default_vocabularies()
OWN = alignment.tokenizers(*PATHS)


PLAIN_A, PLAIN_B = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
PLAIN_A.encode_special_tokens = True


def tokens(text):
    """(ids, start, end) of both tokenizers over the whole text, or nothing."""
    if not text:
        return [], []
    out = []
    for ids, table in ((PLAIN_A.encode(" " + text, add_special_tokens=False).ids, OWN.a_bytes), (PLAIN_B.encode(text), OWN.b_bytes)):
        at, found = 0, []
        for i in ids:
            found.append((i, at, at + len(table[i])))
            at = found[-1][2]
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return [], []
        out.append(found)
    return out


def brute(texts):
    per_doc, held = [], Counter()
    for text in texts:
        ta, tb = tokens(text)
        links = [(i, j) for i, s, e in ta for j, s2, e2 in tb if s < e2 and s2 < e]
        held.update(set(links))
        cuts = sorted({e for _, _, e in ta} & {e for _, _, e in tb})
        groups = [([i for i, s, e in ta if lo <= s and e <= hi], [j for j, s, e in tb if lo <= s and e <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        per_doc.append((len(ta), len(tb), groups, links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    rows = []
    for na, nb, groups, links in per_doc:
        name = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sha = hashlib.sha256(name.encode()).hexdigest() if na else ""
        rows.append((na, nb, len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha))
    return rows, held, [g for _, _, g, _ in per_doc]


TEXTS = [
    "Hello world, it's 12,345 km!", "", None, " leading and  double   spaces\n\tand tabs ", "naïve café — Привет мир 你好世界 \U0001f600!", "has ▁ in it", "the the the the",
    "<|endoftext|> <s> </s> <unk> <0x41>", "a\x1cb c​d ᠎e\x85f", "x" * 300, "don't can't we'll I've", "\x00 null byte", "مرحبا بالعالم", " ", "\n", "the", "a\r\nb", "é ́x",
]


def test_report_and_counts(spark):
    rows, held, groups = brute(TEXTS)
    docs = documents(spark, TEXTS).withColumn("a", F.lit("clash")).withColumn("block", F.lit(1))
    got = {r.doc_id: tuple(r)[1:] for r in alignment.alignment_report(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert got == dict(enumerate(rows))
    counts = {(r.a, r.b): r.n_docs for r in alignment.link_counts(docs).collect()}
    assert counts == dict(held)
    found = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in alignment.aligned_groups(docs).collect()}
    assert found == dict(enumerate(groups))


def test_rows_with_one_id_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "one two", "en", "a", 0)] * 3 + [(None, "one", None, None, None), (None, None, None, None, None)], DOCS).repartition(3)
    got = sorted(tuple(r) for r in alignment.alignment_report(docs).select("n_a", "count_sum", F.coalesce("doc_id", F.lit(-1)).alias("d")).collect())
    assert got == [(0, 0, -1), (1, 4, -1), *[(2, 7, 1)] * 3]
    assert alignment.alignment_report(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é▁ \n\t'日  \x1c᠎!1"), max_size=40) | st.text(max_size=30))
def test_pieces_give_the_tokens_of_the_whole_text(text):
    parts = OWN.pieces(text)
    assert " ".join(parts) == text and OWN.can_cut
    slots = OWN.remember(parts)
    joined = lambda ids, ends: [i for k in slots for i in ids[ends[k] : ends[k + 1]].tolist()]
    assert joined(OWN.a_ids, OWN.a_ends) == PLAIN_A.encode(" " + text, add_special_tokens=False).ids
    if text and "▁" not in text:  # B takes it for a space, and the text has no tokens
        assert joined(OWN.b_ids, OWN.b_ends) == PLAIN_B.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 40)), st.sets(st.integers(1, 40)))
def test_stabbing_finds_overlaps_and_gaps(a, b):
    ends_a, ends_b = np.array(sorted(a | {41})), np.array(sorted(b | {41}))
    first, last, closes = alignment.align(ends_a, ends_b)
    starts_b = [0, *ends_b[:-1].tolist()]
    for k, (s, e) in enumerate(zip([0, *ends_a[:-1].tolist()], ends_a.tolist(), strict=True)):
        hit = [j for j in range(len(ends_b)) if starts_b[j] < e and s < ends_b[j]]
        assert (first[k], last[k]) == (hit[0], hit[-1])
    assert [int(x) for x, c in zip(ends_b, closes, strict=True) if c] == sorted({*ends_a.tolist()} & {*ends_b.tolist()})


def test_files_hold_few_blocks_and_every_block_is_told(spark, monkeypatch):
    """A file's blocks are decoded at once, so a file holds few of them."""
    kept = []
    monkeypatch.setattr(alignment, "FILE_BLOCKS", 2)
    keep = alignment.Scratch.keep
    monkeypatch.setattr(alignment.Scratch, "keep", lambda *args: kept.append(keep(*args)) or kept[-1])
    docs = spark.createDataFrame([(k, "one two " * 150_000 + f"three{k}", "en", "a", 0) for k in range(5)], DOCS).coalesce(1)
    got = alignment.alignment_report(docs).select("n_a", "n_best", "count_sum").collect()
    assert len(kept[0].select("block").collect()) == 3  # slices of two megabytes
    assert sorted(r["count"] for r in kept[0].groupBy(F.input_file_name()).count().collect()) == [1, 2]
    assert len(got) == 5 and all(r.n_best > 300_000 and r.count_sum > 5 * 300_000 for r in got)


def test_texts_are_taken_one_by_one():
    own, taken = alignment.Tokenizers(*alignment.default_vocabularies()), []
    texts = (taken.append(k) or [f"one{k % 2}", "two"] for k in range(4))
    slots = own.remember_each(texts)
    assert taken == [0, 1, 2, 3] and [x.tolist() for x in slots] == [[0, 1], [2, 1], [0, 1], [2, 1]]
    assert len(own.a_ends) == len(own.slots) + 1 == 4 and own.same.all()
