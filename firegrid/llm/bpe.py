"""BPE encoding and decoding with content-defined chunk reuse.

A hash over an 8-byte window cuts texts where their content says so, so copies and shared
passages are cut alike. Chunks that occur twice or more are encoded once; their ids are
joined to the documents, and every join of two chunks is repaired: the stretch between the
nearest boundaries that hold in any context, on either side, is encoded again, and widened
until the boundaries agree with the tokens on both sides. Documents without a shared chunk
are encoded where they are read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import bit_map, bound_arrow_batches, cell, checkpoint, filter_bits, hot_keys, marked, spread_join

SPECIALS = {"<|endoftext|>": 50256}
#: Chunks have 2**CHUNK_BITS bytes on average beyond MIN_CHUNK.
CHUNK_BITS, MIN_CHUNK = 11, 256
#: Where a word piece ends in any context and any script, as no branch of the pattern goes on there: after a letter
#: before what is none, after a digit before what is none, and after a sign (no apostrophe, which may start an
#: ending) before white space, a letter or a digit. White space itself may belong to either side.
_SAFE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])")
#: Two signs that stand together in a special token may be parts of one that goes on in the next chunk.
_IN_SPECIALS = {s[k : k + 2] for s in SPECIALS for k in range(len(s) - 1)}
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Encoder, byte strings by id, and their lengths."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIALS)
        self.bytes_of = [b""] * (max([*ranks.values(), *SPECIALS.values()]) + 1)
        for piece, i in ranks.items():
            self.bytes_of[i] = piece
        for piece, i in SPECIALS.items():
            self.bytes_of[i] = piece.encode()
        self.sizes = np.array([len(x) for x in self.bytes_of])

    def encode(self, raw: bytes) -> np.ndarray:
        return self._encoding.encode_to_numpy(raw.decode("utf-8"), allowed_special="all") if raw else np.empty(0, np.uint32)

    def ordinary(self, text: str) -> list[int]:
        """Ids of the text, in which specials' strings are ordinary text."""
        return self._encoding.encode_ordinary(text)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def clean(raw: bytes | None) -> bytes:
    """A text's bytes; null is empty, and bytes that are no UTF-8 stand as U+FFFD, as in any decoded string."""
    raw = raw or b""
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


def cuts(raw: bytes) -> list[int]:
    """Ends of the text's chunks; every end is a character's end."""
    n = len(raw)
    if n <= MIN_CHUNK + 8:
        return [n] if n else []
    window = np.ndarray((n - 7,), "<u8", raw, strides=(1,))
    found = np.flatnonzero((window * _ROLL) >> np.uint64(64 - CHUNK_BITS) == 0) + 8
    out, last = [], 0
    while True:
        k = np.searchsorted(found, last + MIN_CHUNK)
        if k == len(found):
            break
        last = int(found[k])
        while last < n and raw[last] & 0xC0 == 0x80:
            last += 1
        if last >= n:
            break
        out.append(last)
    return [*out, n]


def chunks(raw: bytes) -> list[bytes]:
    ends = cuts(raw)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def join_ids(parts: list[np.ndarray], own: Codec) -> np.ndarray:
    """Ids of the whole text from the ids of its chunks.

    At each join the stretch from the last sure boundary before it to the first one after it
    is encoded again. A stretch that finds none in a chunk goes on through it, and is encoded once.
    """
    done: list[np.ndarray] = []  # exact ids
    open_ids = parts[0] if parts else np.empty(0, np.uint32)  # exact from its start to its last sure boundary
    stretch: list[bytes] = []
    for right in parts[1:]:
        if not stretch:
            left_at, tail = _last_safe(open_ids, own)
            done.append(open_ids[:left_at])
            stretch.append(tail)
        right_at, head = _first_safe(right, own)
        stretch.append(head)
        if right_at is not None:
            done.append(own.encode(b"".join(stretch)))
            open_ids, stretch = right[right_at:], []
    done.append(own.encode(b"".join(stretch)) if stretch else open_ids)
    return np.concatenate(done)


def _sure(raw: bytes) -> list[int]:
    """The sure boundaries within some bytes of a text, which may begin and end inside a character."""
    skip = next((k for k, x in enumerate(raw[:4]) if x & 0xC0 != 0x80), 0)
    text = raw[skip:].decode("utf-8", "ignore")
    found, at, last = [], skip, 0
    for m in _SAFE.finditer(text):
        if text[m.start() - 1 : m.start() + 1] in _IN_SPECIALS:
            continue
        at += len(text[last : m.start()].encode())
        last = m.start()
        found.append(at)
    return found


def _last_safe(ids: np.ndarray, own: Codec) -> tuple[int, bytes]:
    """The last token that starts at a sure boundary, else 0, and the bytes from there on."""
    reach = 32
    while True:
        first = max(0, len(ids) - reach)
        tail = own.decode(ids[first:])
        starts = np.concatenate([[0], np.cumsum(own.sizes[ids[first:]])]) if len(ids) else np.zeros(1, int)
        for m in reversed(_sure(tail)):
            k = int(np.searchsorted(starts, m))
            if starts[k] == m:
                return first + k, tail[m:]
        if first == 0:
            return 0, tail
        reach *= 4


def _first_safe(ids: np.ndarray, own: Codec) -> tuple[int | None, bytes]:
    """The first token that starts at a sure boundary and the bytes before it; None and all bytes if there is none."""
    reach = 32
    while True:
        head = own.decode(ids[:reach])
        starts = np.concatenate([[0], np.cumsum(own.sizes[ids[:reach]])]) if len(ids) else np.zeros(1, int)
        for m in _sure(head):
            k = int(np.searchsorted(starts, m))
            if starts[k] == m:
                return k, head[:m]
        if reach >= len(ids):
            return None, head
        reach *= 4


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"4" + ids.astype("<u4").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], "<u4") if len(raw) % 2 else np.frombuffer(raw, "<u2").astype(np.uint32)


def encoded_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every row of `docs`; null texts count as empty.

    Bytes that are no UTF-8 are encoded as U+FFFD. Repeated rows and null ids keep a row each; other columns are ignored.
    """
    return _encoded(docs, vocabulary, "ids array<int>, decoded string", lambda ids, own: (ids.astype(np.int32), own.decode(ids).decode("utf-8", "replace")))


def encoding_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids) and decoded_sha256 of every row."""

    def digest(ids: np.ndarray, own: Codec):
        decoded = own.decode(ids).decode("utf-8", "replace").encode()
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _encoded(docs, vocabulary, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _encoded(docs: DataFrame, vocabulary: str | None, columns: str, result) -> DataFrame:
    bound_arrow_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    schema = f"doc_id long, {columns}"
    out_schema = docs.sparkSession.createDataFrame([], schema).schema

    def named(ids: list, found: list) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        values = [*zip(*found, strict=True)] or [[]] * (len(arrow) - 1)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([ids, *values], arrow.types, strict=True)], schema=arrow)

    def cut(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [[_digest(c) for c in chunks(clean(x))] for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "chunks"])

    def straight(batches):
        own = codec(path)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found, last = [], None
            for x in texts:  # repeated rows of a text tend to stand together
                found.append(found[-1] if found and x == last else result(own.encode(clean(x)), own))
                last = x
            yield named(batch.column("doc_id").to_pylist(), found)

    def texts_of(batches):
        for batch in batches:
            seen = {_digest(c): c for x in batch.column("text").cast(pa.binary()).to_pylist() for c in chunks(clean(x))}
            yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.binary()), pa.array([*seen.values()], pa.binary())], ["chunk", "body"])

    def encode(batches):
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array([_packed(own.encode(x)) for x in batch.column("body").to_pylist()], pa.binary())], ["chunk", "ids"])

    def joined(batches):
        own = codec(path)
        for batch in batches:
            parts = [[_unpacked(p["ids"]) for p in x] for x in batch.column("parts").to_pylist()]
            yield named(batch.column("doc_id").to_pylist(), [result(join_ids(x, own), own) for x in parts])

    texts = docs.select("doc_id", "text")
    own_chunks = checkpoint(texts.mapInArrow(cut, "doc_id long, chunks array<binary>").withColumn("row", F.monotonically_increasing_id()))
    held = own_chunks.select("doc_id", F.explode(F.array_distinct("chunks")).alias("chunk")).distinct()
    shared = checkpoint(held.groupBy("chunk").count().filter("count > 1"))
    # Chunks that very many documents hold are dealt over several tasks wherever rows meet by chunk.
    hot = hot_keys(shared, "chunk", shared.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    sharing = spread_join(held, shared.select("chunk"), "chunk", hot, "doc_id", "left_semi").select("doc_id").distinct()
    # Documents are told apart by a bit map of at most 32 MB; both branches use the same bits.
    bits = filter_bits(own_chunks.count())
    maps = checkpoint(bit_map(sharing.select(cell(F.col("doc_id"), bits, 1).alias("cell")).distinct()))
    place = cell(F.col("doc_id"), bits, 1)
    told = marked(texts, maps, place, "sharing")
    alone = told.filter(~F.col("sharing")).select("doc_id", "text").mapInArrow(straight, schema)

    bodies = told.filter("sharing").select("text").mapInArrow(texts_of, "chunk binary, body binary").groupBy("chunk").agg(F.min("body").alias("body"))
    ids = bodies.mapInArrow(encode, "chunk binary, ids binary")
    positions = marked(own_chunks, maps, place, "sharing").filter("sharing").select("row", "doc_id", F.posexplode_outer("chunks").alias("at", "chunk"))
    parts = (
        spread_join(positions, ids, "chunk", hot, "row", "left").groupBy("row", "doc_id")
        .agg(F.sort_array(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("at", "ids")))).alias("parts"))
    )
    return alone.unionByName(parts.select("doc_id", "parts").mapInArrow(joined, schema))
