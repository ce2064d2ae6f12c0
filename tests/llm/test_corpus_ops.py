"""Duplicates, mixing, encoding and the pipeline on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from firegrid.llm import bpe, common, exact_dedup, jaccard, line_dedup, mixing
from firegrid.llm.components import connected_components
from tests.llm.test_filters import DOCS, documents


def word_text(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def test_bit_maps_and_row_filters(spark):
    rows = spark.range(5000).select(F.concat(F.lit("k"), (F.col("id") % 4900).cast("string")).alias("key"), F.col("id").alias("doc_id"))
    seen = common.repeat_filter(rows, "key", 5000)
    marked = {r.key for r in seen.filter("maybe_repeated").select("key").distinct().collect()}
    assert {f"k{i}" for i in range(100)} <= marked and len(marked) < 400 and seen.count() == 5000
    ids = common.checkpoint(rows.filter("doc_id % 7 = 0").select("doc_id"))
    assert common.drop_rows(rows, ids).count() + common.keep_rows(rows, ids).count() == 5000
    assert common.keep_rows(rows, ids).filter("doc_id % 7 <> 0").isEmpty()
    none = common.checkpoint(ids.limit(0))
    assert common.drop_rows(rows, none).count() == 5000 and common.keep_rows(rows, none).isEmpty()


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (2000, None)] + [(3000, 3001 + k) for k in range(200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        if v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_groups(spark):
    texts = ["a b", "ab", " a\nb ", "c", "", None, " ", "d" * 50000, "d" * 50000 + "\n", "é"]
    docs = documents(spark, texts).withColumn("kept", F.lit(0)).withColumn("group_size", F.lit("x"))
    docs = docs.union(docs.filter("doc_id = 3"))
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.copy_groups(docs).collect())
    assert got == sorted([(0, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 3, 2, True), (3, 3, 2, False), (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True), (7, 8, 2, False), (8, 8, 2, True), (9, 9, 1, True)])
    digest = {r.doc_id: r.text_sha256 for r in exact_dedup.copy_groups(docs).collect()}
    assert digest[2] == hashlib.sha256(b"ab").hexdigest() and digest[5] == hashlib.sha256(b"").hexdigest()
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 6, 8, 9]
    assert exact_dedup.copy_groups(docs.limit(0)).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_and_differ_in_text_stay(spark):
    rows = [(1, "aaa"), (2, "a a a"), (1, "unique text"), (2, "other unique"), (None, "null id"), (None, "null  id"), (None, "null  id"), (3, "x y"), (3, "xy ")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOCS)
    left = sorted((r.doc_id or 0, r.text.replace(" ", "")) for r in exact_dedup.drop_copies(docs).collect())
    assert left == [(0, "nullid"), (1, "uniquetext"), (2, "aaa"), (2, "otherunique"), (3, "xy")]
    groups = exact_dedup.copy_groups(docs).collect()
    assert len(groups) == 9 and sum(r.kept for r in groups) == 5 and {r.keep_id for r in groups if r.doc_id is None} == {None}


def brute_groups(texts, words, percent):
    sets = {}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    low, links = {k: k for k in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in sets:
        for b in range(a):
            common_ = len(sets[a] & sets[b])
            if common_ and 100 * common_ >= percent * (len(sets[a]) + len(sets[b]) - common_):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
                links[a], links[b] = links[a] + 1, links[b] + 1
    return {k: (len(s), find(k), links[k]) for k, s in sets.items()}


def near_copies(seed):
    rng = random.Random(seed)
    texts = ["", None, " \t", "one", "ONE", "one two", "a b c", "A  b\nc"]
    for n in (3, 6, 9, 14, 22, 31, 40, 80, 150, 400):
        base = word_text(rng, n).split()
        for _ in range(7):
            edited = list(base)
            for _ in range(rng.randrange(0, max(2, n // 25))):
                edited[rng.randrange(n)] = f"e{rng.randrange(9999)}"
            texts.append(" ".join(edited[: n - rng.randrange(0, max(1, n // 30) + 1)]))
    passage = word_text(rng, 60)
    texts += [word_text(rng, 30, 10**6) + " " + passage + " " + word_text(rng, 30, 10**6) for _ in range(25)]
    return texts


@pytest.mark.parametrize("words, percent, block", [(3, 90, 512), (5, 80, 2)])
def test_jaccard_groups_match_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard, "TILE_BLOCK", block)
    monkeypatch.setattr(jaccard, "LINK_BLOCK", block)
    texts = near_copies(percent)
    docs = documents(spark, texts).withColumn("component_id", F.lit("clash"))
    docs = docs.union(docs.filter("doc_id = 41").withColumn("doc_id", F.lit(None).cast("long"))).union(docs.filter("doc_id in (9, 30)").withColumn("doc_id", F.lit(9000)))
    got = jaccard.similar_groups(docs, jaccard.Threshold(words, percent)).collect()
    assert len(got) == len(texts) + 3
    brute = brute_groups(texts, words, percent)
    # A null id, and an id that stands for two texts, have no links.
    assert [(r.n_shingles, r.component_id, r.n_links) for r in got if r.doc_id is None] == [(brute[41][0], None, 0)]
    assert sorted((r.n_shingles, r.component_id, r.n_links) for r in got if r.doc_id == 9000) == sorted((brute[k][0], 9000, 0) for k in (9, 30))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got if r.doc_id not in (None, 9000)} == brute


def test_repeated_rows_are_rows_of_one_document(spark):
    docs = documents(spark, [" ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}" for k in range(41)), "other words here"])
    got = jaccard.similar_groups(docs.union(docs.filter("doc_id = 0")), jaccard.Threshold(3, 90)).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == [(0, 0, 2), (0, 0, 2), (1, 0, 2), (2, 2, 0)]


@pytest.mark.parametrize("edits", [7, 3])
def test_chain_of_copies_without_a_common_centre(spark, monkeypatch, edits):
    """Texts link to their next ones only; one pivot a tile is not enough, blocks must finish."""
    monkeypatch.setattr(jaccard, "TILE_BLOCK", 4)
    monkeypatch.setattr(jaccard, "LINK_BLOCK", 3)
    words = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(14):
        words[k * edits] = f"x{k}"
        texts.append(" ".join(words))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_groups(documents(spark, texts), jaccard.Threshold(3, 90)).collect()}
    assert got == brute_groups(texts, 3, 90) and len({c for _, c, _ in got.values()}) == 1


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 10**6), st.sampled_from([(3, 90), (5, 80)]))
def test_partners_always_share_a_tile(n, changed, seed, kind):
    threshold = jaccard.Threshold(*kind)
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
    out = min(changed, len(a) - 1)
    b = np.unique(np.concatenate([a[out // 2 :], rng.integers(1, 2**63, out - out // 2, dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    if 100 * both >= threshold.percent * (len(a) + len(b) - both):
        assert len(np.intersect1d(jaccard.signatures(a, threshold), jaccard.signatures(b, threshold)))
        bits = [jaccard.bit_map(x, jaccard.bitmap_words(len(x), threshold)).tobytes() for x in (a, b)]
        assert jaccard._close(len(a), len(b), *bits, threshold)


def test_keep_one_of_each(spark):
    docs = documents(spark, ["a b c d e f g"] * 3 + ["x y z", None, ""])
    left = jaccard.keep_one_of_each(docs, jaccard.Threshold(5, 80))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 3, 4, 5]
    # An id that stands for two texts loses neither, whatever they link with.
    twice = docs.union(docs.filter("doc_id = 0").withColumn("doc_id", F.lit(3)))
    assert sorted(r.doc_id for r in jaccard.keep_one_of_each(twice, jaccard.Threshold(5, 80)).collect()) == [0, 3, 3, 4, 5]
    assert jaccard.similar_groups(docs.limit(0), jaccard.Threshold(5, 80)).count() == 0


def test_mix_meets_its_targets(spark):
    rng = random.Random(1)
    rows = [(k, word_text(rng, rng.randrange(1, 60)) if k % 11 else None, "en", ["b", "a", None, "tiny"][min(3, k % 40 // 12)], 0) for k in range(400)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash"))
    docs = docs.union(docs.filter("doc_id = 7"))
    got = mixing.mix_report(docs).collect()
    assert len(got) == 401 and sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs.repartition(3)).collect()))
    by = {}
    for r in got:
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-9
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - k[1]) <= max(2, 0.01 * k[1]) for k, t in by.items())
    assert sum(k[1] for k in by) == pytest.approx(sum(r.size for r in got))
    report = {r.doc_id: r for r in got if r.doc_id != 7}
    order = [r.doc_id for r in mixing.mixed_documents(docs.filter("doc_id <> 7").drop("target")).collect()]
    first = [report[k].first_slot for k in dict.fromkeys(order) if report[k].size]
    assert len(first) > 200 and sum(a < b for a, b in zip(first, first[1:])) > 0.8 * len(first)
    mixed = mixing.mixed_documents(docs.filter("doc_id <> 7").drop("target"))
    assert mixed.columns == [c for c in docs.columns if c != "target"] and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_slots_are_spread_evenly(spark):
    docs = spark.createDataFrame([(k, "w " * 50, "en", "ab"[k % 2], 0) for k in range(60)], DOCS)
    slots = sorted((r.slot, r.number) for r in mixing.plan_mix(docs, 1 << 10).slots.collect())
    share = np.cumsum([n == 1 for _, n in slots])
    places = np.arange(1, len(slots) + 1)
    assert abs(share - places * share[-1] / len(slots)).max() <= 12


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", None, " ", "\n\n", "don't we'll 'tis 12345 x<|endoftext|>y <|endo", "é" * 3000, "a" * 5000, "日本語テキスト" * 300, "  lead", "tabs\t\tand   runs of   blanks  ", "  x", "🙂🙃" * 400, "word " * 4000]


def test_encoding_matches_the_tokenizer(spark, monkeypatch):
    rng = random.Random(3)
    shared = word_text(rng, 900, 10**5)
    texts = ODD + [word_text(rng, 300, 10**5) + " " + shared + " " + word_text(rng, 10, 10**5) for _ in range(6)] + [shared, shared]
    docs = documents(spark, texts).withColumn("chunk", F.lit(1))
    docs = docs.union(docs.filter("doc_id = 15")).union(docs.filter("doc_id in (4, 16)").withColumn("doc_id", F.lit(None).cast("long")))
    reference = tokenizer()
    rows = bpe.encoding_digests(docs).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        if r.doc_id is not None:
            ids = reference.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            decoded = reference.decode(ids, skip_special_tokens=False)
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    whole = {r.doc_id: r for r in bpe.encoded_documents(docs).collect() if r.doc_id is not None}
    assert all((whole[k].decoded or "") == (t or "") for k, t in enumerate(texts))
    assert bpe.encoding_digests(docs.limit(0)).count() == 0


def test_bytes_that_are_no_text_are_replaced(spark):
    bad = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe tail \xc3")), (2, bytearray(b"fine"))], "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    reference = tokenizer()
    got = {r.doc_id: r for r in bpe.encoding_digests(bad).collect()}
    ids = reference.encode(b"ok \xff\xfe tail \xc3".decode("utf-8", "replace"), add_special_tokens=False).ids
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[2].n_tokens == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  ", "\n", "'ll", "'", "l", "12", "é", "日本", "<|endoftext|>", "<|endo", "ftext|>", ".", "Ab c d", "🙂"]), max_size=60), st.integers(1, 9))
def test_chunk_joins_are_exact(parts, width):
    own, raw = bpe.codec(bpe.default_vocabulary()), "".join(parts).encode()
    ends = sorted({k for k in range(width, len(raw), width) if raw[k] & 0xC0 != 0x80} | {len(raw)} - {0})
    pieces = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
    assert bpe.join_ids([own.encode(p) for p in pieces], own).tolist() == own.encode(raw).tolist()


def test_cuts_follow_content():
    rng = random.Random(9)
    body = word_text(rng, 20000, 10**6).encode()
    moved = set(bpe.chunks(b"another beginning " + body))
    own = bpe.chunks(body)
    assert b"".join(own) == body and len(own) > 10 and sum(c in moved for c in own) > len(own) * 0.8


def plain_lines(texts, run=3, long=50):
    units, lines = [], {}
    for k, t in enumerate(texts):
        own = [(n, x.strip(" \t\n\x0b\x0c\r")) for n, x in enumerate((t or "").split("\n"))]
        lines[k] = own = [(n, x) for n, x in own if x]
        units += [((run, *[x for _, x in own[i : i + run]]), k, i) for i in range(len(own) - run + 1)]
        units += [((1, x), k, i) for i, (_, x) in enumerate(own) if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= long]
    gone, seen = {}, set()
    for key, k, i in sorted(units, key=lambda u: u[1:]):
        if key in seen:
            gone.setdefault(k, set()).update(lines[k][j][0] for j in range(i, i + key[0]))
        seen.add(key)
    return {k: sorted(v) for k, v in gone.items()}


def test_line_runs_match_brute_force(spark):
    rng = random.Random(8)
    passage = "\n".join(word_text(rng, 9, 10**6) for _ in range(6))
    long = word_text(rng, 55, 10**6)
    texts = [None, "", "\n \n", "common\n" * 9]
    for _ in range(20):
        mine = [word_text(rng, 6, 10**6) for _ in range(5)]
        mine.insert(rng.randrange(5), "common")
        mine.insert(rng.randrange(6), rng.choice([passage, long, passage + "\n\n", "\n".join(passage.split("\n")[2:5]), "\n".join(passage.split("\n")[:2])]))
        texts.append("\n".join(mine))
    texts += [texts[7], " " + texts[8].replace("\n", " \r\n")]
    docs = documents(spark, texts).withColumn("lines", F.lit(1))
    docs = docs.union(docs.filter("doc_id = 9"))  # repeated rows share a decision
    gone = plain_lines(texts)
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == [*docs.columns, "_removed"] and got.count() == len(texts) + 1
    for r in got.collect():
        assert r._removed == gone.get(r.doc_id, [])
        kept = "\n".join(x for n, x in enumerate((texts[r.doc_id] or "").split("\n")) if n not in gone.get(r.doc_id, []))
        assert (r.text or "") == kept
    assert line_dedup.line_report(docs.limit(0)).count() == 0


def test_seeds_are_extended_to_maximal_runs(spark):
    rng = random.Random(5)
    line = lambda: word_text(rng, 8, 10**6)
    body = [line() for _ in range(9)]
    texts = ["\n".join([line(), *body, line()]), "\n".join([line(), line(), *body]), "\n".join([*body[2:6], line(), *body[4:]]), "\n".join(body[:2])]
    _, units = line_dedup.repeated_units(documents(spark, texts))
    runs = {r.doc_id: [tuple(x) for x in r.runs] for r in line_dedup.repeated_runs(units).collect()}
    assert runs == {1: [(2, 11, 0, 1)], 2: [(0, 4, 0, 3), (5, 10, 0, 5)]}


def plain_passages(texts, long=50):
    """plain_lines, with pairs of lines of `long` words in sum as further units."""
    gone, seen = {k: {*v} for k, v in plain_lines(texts).items()}, set()
    for k, t in enumerate(texts):
        own = [(n, x.strip(" \t\n\x0b\x0c\r")) for n, x in enumerate((t or "").split("\n"))]
        own = [(n, x) for n, x in own if x]
        for (m, a), (n, b) in zip(own, own[1:]):
            if len(re.findall(r"[^\x20\x09-\x0D]+", a + " " + b)) >= long:
                if (a, b) in seen:
                    gone.setdefault(k, set()).update((m, n))
                seen.add((a, b))
    return {k: sorted(v) for k, v in gone.items()}


def test_passages_of_two_lines_are_caught(spark):
    rng = random.Random(3)
    line = lambda n: word_text(rng, n, 10**6)
    passages = [f"{line(a)}\n{line(b)}" for a, b in ((4, 47), (43, 49), (25, 25), (1, 49), (24, 25), (49, 0))]
    texts = [f"{line(6)}\n{p}\n{line(7)}" for p in passages for _ in range(3)]
    one, same = line(26), line(30)
    texts += [passages[0], passages[1].replace("\n", " \r\n\n\t"), "\n".join([one] * 2), "\n".join([same] * 3), "\n".join([one, same] * 2), passages[2].split("\n")[0], None]
    gone = plain_passages(texts)
    got = {r.doc_id: r._removed for r in line_dedup.drop_repeated_lines(documents(spark, texts)).collect()}
    assert got == {k: gone.get(k, []) for k in range(len(texts))}
    assert [got[k] for k in (0, 1, 4, 7, 10, 13, 16, 18, 19)] == [[], [1, 2], [1, 2], [1, 2], [1, 2], [], [], [0, 1], [0, 2]]
    assert not plain_lines(texts[:19]) and got[21] == [1, 2]


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(6)
    texts = [word_text(rng, 80, 10**5) for _ in range(60)]
    texts += [texts[0], texts[1] + " ", texts[2] + " extra", None, ""] + [word_text(rng, 60, 10**5) + " scum" for _ in range(40)]
    rows = [(k, t, "en", "ab"[k % 2], len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(k, 1, int(k >= 65)) for k in range(len(rows))]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    near = spark.read.parquet(str(tmp_path / "stage2"))
    ids = {r.doc_id for r in near.collect()}
    assert not ids & {60, 62} and not ids & {1, 61} == {1, 61} and len(ids & {*range(60)}) >= 59
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


ALPHABETS = {"cyrillic": "абвгдежзийклмнопрст     ,.\n", "han": "的一是在不了有和人这中大为上个国我以要他,。", "mixed": "a é'sd1 2.,!\n\tйЮ的 \u200b\U0001f600'llré<|>\x1c\u0301"}


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(ALPHABETS)), st.integers(0, 10**6), st.integers(1, 9))
def test_joins_in_any_script(name, seed, step):
    own, rng = bpe.codec(bpe.default_vocabulary()), random.Random(seed)
    text = "".join(rng.choice([*ALPHABETS[name], "<|endoftext|>"] if name == "mixed" else ALPHABETS[name]) for _ in range(120))
    for parts in (bpe.chunks(text.encode()), [text[k : k + step].encode() for k in range(0, len(text), step)]):
        assert bpe.join_ids([own.encode(x) for x in parts], own).tolist() == own.encode(text.encode()).tolist()


def test_joins_are_linear_in_any_script():
    import time

    own, rng = bpe.codec(bpe.default_vocabulary()), random.Random(7)
    for alphabet in (ALPHABETS["cyrillic"], "йцукенгшщзхъфывапролджэ"):  # the second has no boundary at all
        raw = "".join(rng.choice(alphabet) for _ in range(500_000 if " " in alphabet else 30_000)).encode()
        parts = [own.encode(x) for x in bpe.chunks(raw)]
        began = time.time()
        ids = bpe.join_ids(parts, own)
        assert time.time() - began < 5 and ids.tolist() == own.encode(raw).tolist() and len(parts) > 10


def test_lines_of_a_long_text_take_linear_time(spark):
    """Sixteen times the lines, far from sixteen squared times the time; every line of the copy goes but the changed one."""
    import time

    took = []
    for n in (2_000, 32_000):
        lines = [f"line {k} of the long text" for k in range(n)]
        docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join([*lines[:-5], "another", *lines[-4:]]))], "doc_id long, text string")
        began = time.time()
        got = {r.doc_id: r.n_removed for r in line_dedup.line_report(docs).collect()}
        took.append(time.time() - began)
        assert got == {1: 0, 2: n - 1}
    assert took[1] < 16 * max(took[0], 2)
