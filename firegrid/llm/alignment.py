"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

Every text is encoded as A (byte-level BPE of a space and the text) and as B (sentencepiece,
which adds the space). The B tokens' byte ranges are a static index of disjoint intervals;
every A token stabs it by bisection and gets the run of B tokens that it overlaps. Gaps
between B tokens that no A token spans are the boundaries of groups, which are the smallest
stretches where both tokenizers start and end.

A space between two characters that are no white space starts a token of both tokenizers
whatever stands around it (for B this is read off its pieces), so texts are cut there, and
each distinct piece of a batch is encoded and aligned once. Results are those of whole texts.

Documents are handled in blocks of a few megabytes. Only a block's distinct id pairs travel:
they meet once by their A id, are counted over the corpus and sent back to their block as
sorted rows, so a pair that every document holds is one row a block. A task holds a few
blocks' pairs, however many there are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firegrid.llm import bpe
from firegrid.llm.common import Scratch, bound_arrow_batches, release_memory, text_slices

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A worker forgets its pieces before the batch that finds more of them than this; pieces that are encoded in one text.
REMEMBERED_PIECES, ENCODED_TOGETHER = 60_000, 1024
#: Blocks of a file, which are decoded at once; blocks whose pairs one task counts, and that one task gives their counts, on average.
FILE_BLOCKS, COUNTED_BLOCKS, TOLD_BLOCKS = 4, 12, 8


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return bpe.default_vocabulary(), public_tokenizers.path("piece_bpe_32k.model")


class _Slots(dict):
    """Numbers of the pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = slot = len(self)
        return slot


class Tokenizers:
    """Both encoders, and the byte strings of their ids. A's specials are ordinary text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = bpe.codec(a_path)
        self.a_bytes, self.a_sizes = self.a.bytes_of, self.a.sizes
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        # A cut before a space holds for B if no piece goes on over one.
        self.can_cut = not any("▁" in p.lstrip("▁") for p, _ in pieces)
        self.forget()

    def forget(self) -> None:
        """Start the remembered pieces anew: their slots, and their ids and whether their bytes hold, by slot."""
        self.slots = _Slots()
        self.a_ids = self.b_ids = np.empty(0, np.int32)
        self.a_ends = self.b_ends = np.zeros(1, np.int64)
        self.same = np.empty(0, bool)

    def pieces(self, text: str) -> list[str]:
        """The text's pieces, each without the space before it; joined by spaces they are the text."""
        if not self.can_cut:
            return [text]
        first, *rest = _CUT.split(" " + text)
        return [first[1:], *rest]

    def remember(self, pieces: list[str]) -> np.ndarray:
        return self.remember_each([pieces])[0]

    def remember_each(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        """Slots of every text's pieces; new ones are encoded. `same` tells whether the bytes of both tokenizers are a space and the piece.

        The texts are taken one by one, so that of their pieces only the new ones are held.
        """
        known = len(self.slots)
        slots = [np.fromiter(map(self.slots.__getitem__, x), np.int32, len(x)) for x in texts]
        new, found = list(islice(self.slots, known, None)), []
        for at in range(0, len(new), ENCODED_TOGETHER):
            some = new[at : at + ENCODED_TOGETHER]
            raw = [b" " + p.encode() for p in some]
            together = self.can_cut and not any(not p or p.strip() != p for p in some)
            a = _ids(some, raw, lambda x: [self.a.ordinary(" " + p) for p in x], self.a_bytes, self.a_sizes, together)
            found.append((*a, *_ids(some, raw, lambda x: self.b.encode(x, num_threads=1), self.b_bytes, self.b_sizes, together)))
        if found:
            a_ids, a_sizes, same_a, b_ids, b_sizes, same_b = map(np.concatenate, zip(*found, strict=True))
            self.a_ids, self.a_ends = np.concatenate([self.a_ids, a_ids]), np.concatenate([self.a_ends, self.a_ends[-1] + np.cumsum(a_sizes)])
            self.b_ids, self.b_ends = np.concatenate([self.b_ids, b_ids]), np.concatenate([self.b_ends, self.b_ends[-1] + np.cumsum(b_sizes)])
            self.same = np.concatenate([self.same, same_a & same_b])
        return slots


def _ids(pieces: list[str], raw: list[bytes], encode, bytes_of: list[bytes], sizes: np.ndarray, together: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tokens, same) of the pieces: `together` in one text, as a space starts a token, or one by one where that text's bytes differ."""
    if together:
        (ids,) = encode([" ".join(pieces)])
        if b"".join(map(bytes_of.__getitem__, ids)) == b"".join(raw):
            ids = np.array(ids, np.int32)
            ends = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum([len(x) for x in raw])) + 1
            return ids, np.diff(ends, prepend=0), np.ones(len(raw), bool)
    found = encode(pieces)
    same = np.array([b"".join(map(bytes_of.__getitem__, x)) == y for x, y in zip(found, raw, strict=True)], bool)
    return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found]), same


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, closes): the B tokens that every A token overlaps, and which B tokens end a group.

    Tokens are given by their ends on one axis of bytes that both cover from 0 on without a
    gap. The index is the sorted B intervals; a stabbing query bisects it at either end of
    the A token. Token i spans the gaps first..last-1.
    """
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    first = np.searchsorted(b_ends, a_starts, "right")
    last = np.searchsorted(b_starts, a_ends, "left") - 1
    n = len(b_ends)
    spans = np.cumsum(np.bincount(first, minlength=n) - np.bincount(last, minlength=n))
    return first, last, spans == 0


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start..start+size-1 of every pair, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


class Batch:
    """The aligned pieces of a batch of texts.

    doc, piece, times: which piece each text holds, and how often; text n holds the pieces
    `order[order_ends[n]:order_ends[n + 1]]`. Texts without tokens hold none.
    """

    def __init__(self, texts: list[str], own: Tokenizers):
        if len(own.slots) > REMEMBERED_PIECES:
            own.forget()
        parts = own.remember_each(own.pieces(x) if x else [] for x in texts)
        order = np.concatenate([np.empty(0, np.int32), *parts])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(~own.same[order]), "right") - 1).tolist()
        if odd:  # then the whole text decides
            for n, whole in zip(odd, own.remember_each([texts[n]] for n in odd), strict=True):
                parts[n] = whole[own.same[whole]]
            order, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        used, self.order = np.unique(order, return_inverse=True)
        self.order_ends, self.texts = ends, len(texts)
        self.n_a, self.n_b = own.a_ends[used + 1] - own.a_ends[used], own.b_ends[used + 1] - own.b_ends[used]
        self.a, self.b = own.a_ids[_ragged(own.a_ends[used], self.n_a)], own.b_ids[_ragged(own.b_ends[used], self.n_b)]
        self.first, self.last, self.closes = align(np.cumsum(own.a_sizes[self.a]), np.cumsum(own.b_sizes[self.b]))
        self.group_of_b = np.cumsum(self.closes) - self.closes
        self.group_of_a = self.group_of_b[self.first]
        # Every piece ends a group, so its groups and links are those of its own tokens.
        a_at, b_at = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        overlaps = self.last - self.first + 1
        self.n_groups = np.add.reduceat(self.closes.astype(np.int64), b_at) if len(used) else b_at
        self.n_links = np.add.reduceat(overlaps, a_at) if len(used) else a_at
        key = np.repeat(self.a.astype(np.int64), overlaps) << 32 | self.b[_ragged(self.first, overlaps)]
        self.pairs, self.link = np.unique(key, return_inverse=True)
        width = max(1, len(used))
        held, self.times = np.unique(np.repeat(np.arange(len(texts)), np.diff(ends)) * width + self.order, return_counts=True)
        self.doc, self.piece = held // width, held % width

    def groups(self) -> list[list[dict]]:
        """The groups, as {"a": ids of A, "b": ids of B}, of every text."""
        a_ends, b_ends = (np.concatenate([[0], np.cumsum(np.bincount(x))]).astype(np.int64).tolist() for x in (self.group_of_a, self.group_of_b))
        a, b = self.a.tolist(), self.b.tolist()
        flat = [{"a": a[p:q], "b": b[r:s]} for p, q, r, s in zip(a_ends, a_ends[1:], b_ends, b_ends[1:], strict=False)]
        ends = np.concatenate([[0], np.cumsum(self.n_groups)]).tolist()
        of_text = [self.order[x:y].tolist() for x, y in zip(self.order_ends, self.order_ends[1:], strict=False)]
        return [[g for p in x for g in flat[ends[p] : ends[p + 1]]] for x in of_text]

    def names(self) -> pa.Array:
        """`a1,a2|b1;a3|b2,b3` of every text: the decimal ids of its groups; empty without tokens."""
        n_a, n_b = np.bincount(self.group_of_a), np.bincount(self.group_of_b)
        a_at = np.arange(len(self.a)) + (np.cumsum(n_b) - n_b)[self.group_of_a]
        b_at = np.arange(len(self.b)) + np.cumsum(n_a)[self.group_of_b]
        ids, mark = np.empty(len(a_at) + len(b_at), np.int32), np.zeros(len(a_at) + len(b_at), np.int8)
        ids[a_at], ids[b_at] = self.a, self.b
        ends = np.cumsum(n_a + n_b)
        mark[ends - n_b - 1], mark[ends - 1] = 1, 2
        last = np.cumsum(self.n_a + self.n_b) - 1  # the last id of a piece: texts put the ; between pieces
        mark[last] = 3
        marks = pa.DictionaryArray.from_arrays(pa.array(mark), [",", "|", ";", ""]).cast(pa.string())
        flat = pc.binary_join_element_wise(pa.array(ids).cast(pa.string()), marks, "")
        of_piece = pc.binary_join(_lists(flat, self.n_a + self.n_b), "")
        return pc.binary_join(_lists(of_piece.take(pa.array(self.order)), np.diff(self.order_ends)), ";")

    def total(self, of_piece: np.ndarray) -> np.ndarray:
        """Sums of a figure of pieces over every text."""
        return np.bincount(self.doc, of_piece[self.piece] * self.times, self.texts).astype(np.int64) if len(of_piece) else np.zeros(self.texts, np.int64)

    def texts_of_pairs(self) -> np.ndarray:
        """How many texts hold each pair linked."""
        starts = np.cumsum(self.n_links) - self.n_links
        sizes = self.n_links[self.piece] if len(self.n_links) else np.empty(0, np.int64)
        links = self.link[_ragged(starts[self.piece] if len(starts) else sizes, sizes)]
        width = max(1, len(self.pairs))
        held = np.unique(np.repeat(self.doc, sizes) * width + links)
        return np.bincount(held % width, minlength=len(self.pairs)) if len(self.pairs) else np.empty(0, np.int64)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [bpe.clean(x).decode() for x in batch.column("text").cast(pa.binary()).to_pylist()]


def aligned_groups(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id and groups, array<struct<a:array<int>,b:array<int>>>, of every row of `docs`, in order.

    Texts that are null or empty, or whose tokens' bytes are not a space and the text (as when
    it holds U+2581, which B decodes as a space), have no groups. Bytes that are no UTF-8 stand
    as U+FFFD. Repeated rows and null ids keep a row each; other columns are ignored.
    """
    bound_arrow_batches(docs.sparkSession)
    paths = vocabularies or default_vocabularies()
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def kernel(batches):
        own = tokenizers(*paths)
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(Batch(_texts(batch), own).groups(), kind)], ["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(kernel, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


_BLOCK = """block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>,
    doc array<int>, piece array<int>, times array<int>, links array<int>, piece_links array<int>, a array<int>, b array<int>, docs array<int>"""


def _blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A row a block: its documents' figures, its pieces' links, and its distinct pairs with the number of documents that hold them."""

    def kernel(batches):
        own, part = tokenizers(*paths), TaskContext.get().partitionId()
        for number, batch in enumerate(text_slices(batches)):
            found = Batch(_texts(batch), own)
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in found.names().cast(pa.binary()).to_pylist()]
            long = lambda x: _lists(x if isinstance(x, pa.Array) else pa.array(x, pa.int64()), np.array([len(x)]))
            int_ = lambda x: _lists(pa.array(x, pa.int32()), np.array([len(x)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 33 | number], pa.int64()), long(batch.column("doc_id")),
                    *(long(found.total(x)) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)), _lists(pa.array(digests, pa.string()), np.array([len(digests)])),
                    *map(int_, (found.doc, found.piece, found.times, found.link, found.n_links, found.pairs >> 32, found.pairs & 0xFFFFFFFF, found.texts_of_pairs())),
                ],
                [c.split()[0] for c in _BLOCK.split(",")],
            )
            del found, digests
            release_memory()
        own.forget()  # the worker waits for its next task, while others sort
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(kernel, _BLOCK)


def _counted(pairs: DataFrame) -> DataFrame:
    """`pairs` (a, b, docs and others) with n_docs and is_best: documents that hold the pair, and whether no pair of this A id has more."""
    counts = pairs.withColumn("n_docs", F.sum("docs").over(Window.partitionBy("a", "b")))
    return counts.withColumn("is_best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def _pairs(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("at", "p")).select("block", "at", "p.*")


def link_counts(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """(a, b, n_docs, is_best): every pair of ids that overlap anywhere, and the number of documents (rows) that hold it linked."""
    bound_arrow_batches(docs.sparkSession)
    pairs = _pairs(_blocks(docs, vocabularies or default_vocabularies())).groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    return _counted(pairs.repartition("a")).select("a", "b", "n_docs", "is_best")


def alignment_report(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of `docs`.

    n_best counts the links whose pair no other pair of the same A id exceeds in documents;
    count_sum adds up the pairs' documents over all links. Rows are as in aligned_groups, and
    rows that repeat a doc_id count as documents of their own. The blocks are kept in the
    shared folder; a document's blocks are read back by block, never by pair.
    """
    bound_arrow_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.keep("blocks", _blocks(docs, vocabularies or default_vocabularies()), FILE_BLOCKS)
    many = blocks.count()
    # A pair occurs once a block, so even an A id that all documents hold has few rows for each block.
    pairs = _pairs(blocks.select("block", "a", "b", "docs")).repartition(-(-many // COUNTED_BLOCKS) or 1, "a")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    deal = lambda df: df.repartition(-(-many // TOLD_BLOCKS) or 1, "block").groupBy("block")
    told = deal(_counted(pairs).select("block", "at", "n_docs", "is_best"))

    def kernel(block: pa.Table, told: pa.Table) -> pa.Table:
        value = lambda name: block.column(name).combine_chunks().flatten()
        numbers = lambda name: value(name).to_numpy(zero_copy_only=False)
        rows = len(value("doc_id"))
        best, sums = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        if told.num_rows:
            at = told.column("at").to_numpy()
            starts = np.cumsum(numbers("piece_links")) - numbers("piece_links")
            doc, piece, times, links = (numbers(c) for c in ("doc", "piece", "times", "links"))
            for name, out in (("is_best", best), ("n_docs", sums)):
                figure = np.zeros(len(at), np.int64)
                figure[at] = told.column(name).to_numpy()
                np.add.at(out, doc, np.add.reduceat(figure[links], starts)[piece] * times)
        return pa.table([*map(value, columns), pa.array(best), pa.array(sums)], [*columns, "n_best", "count_sum"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    held = deal(blocks.select("block", *columns, "doc", "piece", "times", "links", "piece_links"))
    return held.cogroup(told).applyInArrow(kernel, schema)
