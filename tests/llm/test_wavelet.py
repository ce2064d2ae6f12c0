"""Wavelet-matrix shards against plain arrays and the tokenizer's own ids."""

import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firegrid.llm import wavelet
from tests.llm.test_filters import DOCS, documents

PLAIN = Tokenizer.from_file(wavelet.default_vocabulary())
OWN = wavelet.encoder(wavelet.default_vocabulary())


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1500), st.data())
def test_matrix(values, data):
    array = np.array(values, np.uint32)
    matrix = wavelet.WaveletMatrix(len(values), *wavelet.WaveletMatrix.build(array, 9))
    assert matrix.values().tolist() == values
    at = np.array(data.draw(st.lists(st.integers(0, max(0, len(values) - 1)), max_size=5 if values else 0)), np.int64)
    assert matrix.access(at).tolist() == [values[k] for k in at]
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    asked = np.array([0, 7, 300, 511, 512, -1])
    assert matrix.count(asked, a, b).tolist() == [values[a:b].count(x) for x in asked]
    for x in {*values[:3], 301, 5000}:
        assert matrix.places(x).tolist() == [k for k, v in enumerate(values) if v == x]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é'sÉΣİ.,&<|>́ \t\n\x1c\x85ſ9日"), max_size=30) | st.text(st.characters(max_codepoint=0x24F), max_size=30) | st.text(max_size=20) | st.just("x<|endoftext|>y z<|startoftext|>"), max_size=4))
def test_words_give_the_ids_of_the_whole_text(texts):
    ids, ends = OWN.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends[:-1])][: len(texts)] == [PLAIN.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_are_encoded_once_whatever_stands_around_them(monkeypatch):
    own, asked = wavelet.Encoder(wavelet.default_vocabulary()), []
    plain = own._ids
    monkeypatch.setattr(own, "_ids", lambda pieces, kind: asked.extend(pieces) or plain(pieces, kind))
    texts = [f"{a}{w}{b}" for w in ("wall", "Wall", "WALL", "Élan", "éLAN") for a in ("", "(", "7") for b in ("", ",", ".", "77", "(wall,7")] + ["don't", "Don't don't"]
    for _ in range(2):
        ids, ends = own.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [PLAIN.encode(x, add_special_tokens=False).ids for x in texts]
    assert sorted(asked) == sorted(["wall", "élan", "(", "7", ",", ".", "don't", "Don't"])


def test_every_plain_letter_and_a_forgotten_memory(monkeypatch):
    monkeypatch.setattr(wavelet, "REMEMBERED_BYTES", 100)
    own = wavelet.Encoder(wavelet.default_vocabulary())
    for texts in [[f"{chr(c)} a{chr(c)}B1{chr(c)}{chr(c)}. 日{chr(c)}" for c in range(1, 0x300)], ["", " "], [None, "\x1c", ""], [], ["\x85"], ["wall"]]:
        ids, ends = own.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == [i for x in texts for i in PLAIN.encode(x or "", add_special_tokens=False).ids] and len(ends) == len(texts)
    assert own.pieces.to_pylist() == ["\x1c", "\x85", "wall"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    rows = [(k * 7 % 101 - 20, words(rng.randrange(60)), "en", "a", 0) for k in range(101)]
    rows += [(None, None, None, None, None), (None, "no id", None, None, None), (500, "", "en", "a", 0), (501, "long " * 30_000, "en", "a", 0)]
    rows += [(400, f"one id {k % 9} of many", "en", "a", 0) for k in range(300)]
    return spark.createDataFrame(rows, DOCS).repartition(5).withColumn("part", F.lit("clash")).withColumn("order", F.lit(1)).cache()


def in_order(odd):
    rows = [(r.doc_id, ids_of(r.text)) for r in odd.collect()]
    raw = lambda x: np.array(x, "<u2").tobytes()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(raw(r[1])), raw(r[1])))


def test_shards(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "PART_BYTES", 8_000)
    folder = str(tmp_path / "shards")
    wavelet.write_shards(odd, folder, shard_tokens=700)
    shards = wavelet.read_shards(spark, folder)
    assert shards.count() == len(glob.glob(folder + "/*.parquet")) > 10 and shards.select("part").distinct().count() > 5
    assert shards.filter("size(doc_ids) > 1").agg(F.max("n_tokens")).first()[0] <= 700
    assert shards.filter("array_contains(doc_ids, 400)").select("part").distinct().count() > 1  # an id that fills parts is dealt over them
    rows = in_order(odd)
    flat = [x for _, ids in rows for x in ids]
    start, want = 0, []
    for doc_id, ids in rows:
        want.append((start, doc_id, len(ids), ids))
        start += len(ids)
    got = sorted((r.start, r.doc_id, r.n_tokens, list(r.ids)) for r in wavelet.read_documents(shards).collect())
    assert got == want
    asked = [2, flat[0], 49407, 60_000]
    assert {r.id: r.n for r in wavelet.token_counts(shards, asked).collect()} == {x: flat.count(x) for x in asked}
    places = sorted((r.id, r.doc_id is not None, r.doc_id or 0, r.place) for r in wavelet.occurrences(shards, [2, flat[0]]).collect())
    assert places == sorted((x, d is not None, d or 0, k) for x in {2, flat[0]} for d, ids in rows for k, v in enumerate(ids) if v == x)
    positions = spark.createDataFrame([(0,), (5,), (len(flat) - 1,), (len(flat),), (1234,), (1234,), (None,), (-3,)], "position long")
    assert sorted((r.position, r.id) for r in wavelet.tokens_at(shards, positions).collect()) == [(k, flat[k]) for k in sorted({0, 5, 1234, len(flat) - 1})]


def test_report(spark, odd):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in wavelet.token_report(odd).collect())
    start, want = 0, []
    for doc_id, ids in in_order(odd):
        want.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert wavelet.token_report(documents(spark, []).limit(0)).count() == 0
