"""Token ids in files of bit planes: a wavelet matrix a shard.

Texts are encoded, dealt over parts by ranges of doc_id, sorted there, and written as shards
of whole documents, each one row of a compressed Parquet file of its own. A shard holds its
documents' ids and ends, and its tokens as a wavelet matrix: plane k has the k-th bit of every
token, from the highest on, after the tokens were stably parted by the bits before it. With a
count of ones every 512 bits, planes answer rank and select, so that a token at a place, the
occurrences of an id and their places are found without unpacking the others.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firegrid.llm.bpe import clean
from firegrid.llm.common import bound_arrow_batches, shared_folder, small, text_slices

END_ID = 2
#: Tokens of a shard at most, unless one document is longer; text bytes of a part, and parts at most.
SHARD_TOKENS, PART_BYTES, MAX_PARTS = 1 << 21, 32 << 20, 100_000
#: A worker forgets its pieces before the batch that finds more bytes of them and their ids than this; pieces that are encoded in one text.
REMEMBERED_BYTES, ENCODED_TOGETHER = 32 << 20, 64
#: Text bytes that are encoded at once, unless one text is longer.
ENCODED_BYTES = 8 << 20
_NULL_ID = -(1 << 63)
#: Plain words have only letters, digits and signs of these. Not among them: the apostrophe, which starts endings, the
#: signs of special tokens, U+0130, whose lower case is no letter, and other scripts.
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", '!"#$%&()*+,./:;=?@^_`~-'
_PLAIN = rf"\A[{_LETTERS}0-9{_SIGNS}]+\z"
#: Kinds of bytes of a plain word: bytes of letters 0, digits 1, signs 2.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"0123456789")], _KIND[list(_SIGNS.encode())] = 1, 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """A tokenizer that drops white space: each piece of a word between blanks is encoded once, whatever stands around it.

    A plain word falls into pieces: runs of letters, single digits and runs of signs, in lower
    case, where the vocabulary parts words so; any other word is one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits = max(1, max(self.tokenizer.get_vocab(with_added_tokens=True).values()).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.is_end = np.zeros(1 << self.bits, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.is_end[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        whole, parted = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("\u00c9aB12c!?d\u00f1", "\u00e9ab 1 2 c !? d\u00f1"))
        self.parts_words = whole == parted and int(self.is_end[whole].sum()) == 6
        self.forget()

    def forget(self) -> None:
        self.pieces, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def _is_plain(self, words: pa.StringArray) -> pa.BooleanArray:
        return pc.match_substring_regex(words, _PLAIN) if self.parts_words else pa.array(np.zeros(len(words), bool))

    def _ids(self, pieces: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids, one after the other, and how many each has; ENCODED_TOGETHER pieces are encoded in one text.

        A plain piece's ids end with the only one of them that ends a word; in others a token's offset tells its piece.
        """
        parts = [pieces[at : at + ENCODED_TOGETHER] for at in range(0, len(pieces), ENCODED_TOGETHER)]
        texts = [" ".join(p) for p in parts]
        if plain:
            ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], self.kind)
            ends = np.flatnonzero(self.is_end[ids])
            if len(ends) == len(pieces):
                return ids, np.diff(ends, prepend=-1)
        ids, sizes = [], []
        for part, text in zip(parts, texts, strict=True):
            found = self.tokenizer.encode(text, add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])[:-1]
            of = np.searchsorted(starts, np.array([a for a, _ in found.offsets], np.int64), "right") - 1
            ids.append(np.array(found.ids, self.kind))
            sizes.append(np.bincount(of, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _pieces(self, words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """(pieces, bounds): the pieces of all words one after the other; word k's are those from bounds[k] to bounds[k + 1]."""
        plain = self._is_plain(words)
        lower = pc.if_else(plain, pc.utf8_lower(words), words)
        offsets = np.frombuffer(lower.buffers()[1], np.int32)[lower.offset : lower.offset + len(lower) + 1]
        kind = _KIND[np.frombuffer(lower.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
        cut = np.ones(len(kind) + 1, bool)
        np.logical_or(kind[1:] != kind[:-1], kind[1:] == 1, out=cut[1:-1])
        cut[:-1] &= np.repeat(plain.to_numpy(zero_copy_only=False), np.diff(offsets))
        cut[offsets - offsets[0]] = True
        starts = np.flatnonzero(cut)
        pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer((starts + offsets[0]).astype(np.int32)), lower.buffers()[2])
        return pieces, np.searchsorted(starts, offsets - offsets[0])

    def _places(self, pieces: pa.StringArray) -> np.ndarray:
        """Where each piece stands in `self.pieces` and `self.ids`; those not met before are encoded."""
        if self.pieces.nbytes + self.ids.nbytes > REMEMBERED_BYTES:
            self.forget()
        coded = pieces.dictionary_encode()
        places = np.full(len(coded.dictionary), -1, np.int32)
        met = pc.index_in(self.pieces, coded.dictionary)
        places[met.drop_null().to_numpy()] = np.flatnonzero(met.is_valid().to_numpy(zero_copy_only=False))
        plain = self._is_plain(coded.dictionary).to_numpy(zero_copy_only=False)
        for is_plain in (True, False):
            new = (places < 0) & (plain == is_plain)
            some = coded.dictionary.filter(pa.array(new))
            if len(some):
                places[new] = np.arange(len(self.pieces), len(self.pieces) + len(some))
                ids, sizes = self._ids(some.to_pylist(), is_plain)
                encoded = _stretches(ids, np.concatenate([[0], np.cumsum(sizes)]))
                self.pieces, self.ids = pa.concat_arrays([self.pieces, some]), pa.concat_arrays([self.ids, encoded])
        return places[coded.indices.to_numpy()]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts one after the other, and where each text's end."""
        split = pc.ascii_split_whitespace(texts)
        words, offsets = split.flatten(), split.offsets.to_numpy()
        real = pc.greater(pc.binary_length(words), 0)
        bounds = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[offsets - offsets[0]]
        coded = words.filter(real).dictionary_encode()
        if not len(coded):
            return np.empty(0, self.kind), np.zeros(len(bounds) - 1, np.int64)
        pieces, of = self._pieces(coded.dictionary)
        places = self._places(pieces)
        ids, ends = _taken(self.ids, places, self.kind)
        ids, ends = _taken(_stretches(ids, ends[of]), coded.indices, self.kind)
        return ids, ends[bounds[1:]]


def _stretches(ids: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """The ids' bytes from each end to the next."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])


def _taken(stretches: pa.BinaryArray, places: np.ndarray | pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of the stretches at `places` one after the other, and where each begins, with the end of the last."""
    found = stretches.take(places if isinstance(places, pa.Array) else pa.array(places))
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
    raw = found.buffers()[2] if ends[-1] > ends[0] else b""
    return np.frombuffer(raw, kind)[ends[0] // kind.itemsize : ends[-1] // kind.itemsize], (ends - ends[0]) // kind.itemsize


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class WaveletMatrix:
    """Bit planes over n values, each with its number of zeros and its ones in every 512 bits."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ones: list[bytes]):
        self.n, self.zeros, self.bits = n, zeros, len(zeros)
        self.planes = [np.frombuffer(x, "<u8").reshape(-1, 8) for x in planes]
        self.before = [np.concatenate([[0], np.cumsum(np.frombuffer(x, "<u2"), dtype=np.int64)]) for x in ones]

    @staticmethod
    def build(values: np.ndarray, bits: int) -> tuple[list[int], list[bytes], list[bytes]]:
        """(zeros, planes, ones) of the values, from the highest bit on."""
        zeros, planes, ones = [], [], []
        size = len(values) // 512 + 1
        values = values.astype(np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            bit = (values >> k & 1).astype(bool)
            packed = np.zeros(64 * size, np.uint8)
            packed[: (len(bit) + 7) // 8] = np.packbits(bit, bitorder="little")
            planes.append(packed.tobytes())
            ones.append(np.bitwise_count(packed.view("<u8")).reshape(-1, 8).sum(axis=1).astype("<u2").tobytes())
            values = np.concatenate([values.compress(~bit), values.compress(bit)])
            zeros.append(len(values) - int(bit.sum()))
        return zeros, planes, ones

    def _bits(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k].view(np.uint8).reshape(-1), count=self.n, bitorder="little").astype(bool)

    def rank(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each place."""
        block, inside = at >> 9, at & 511
        words = self.planes[k][block]
        here = np.clip(inside[:, None] - np.arange(0, 512, 64), 0, 64).astype(np.uint64)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask = np.where(here == 64, full, (np.uint64(1) << (here & np.uint64(63))) - np.uint64(1))
        return self.before[k][block] + np.bitwise_count(words & mask).sum(axis=1, dtype=np.int64)

    def select(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Where the nth one (or zero) of plane k stands, from 0."""
        before = self.before[k] if bit else np.arange(len(self.before[k])) * 512 - self.before[k]
        block = np.searchsorted(before, nth, "right") - 1
        out = np.empty(len(nth), np.int64)
        for a in range(0, len(nth), 4096):
            some = slice(a, a + 4096)
            inside = np.unpackbits(self.planes[k][block[some]].view(np.uint8), axis=1, bitorder="little") == bit
            left = nth[some] - before[block[some]]
            out[some] = block[some] * 512 + (np.cumsum(inside, axis=1) > left[:, None]).argmax(axis=1)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at the places."""
        at, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for k in range(self.bits):
            word = self.planes[k].reshape(-1)[at >> 6]
            bit = (word >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self.rank(k, at)
            out = out << 1 | bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return out

    def spans(self, values: np.ndarray, start: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(low, high): where the occurrences of each value in start..end-1 stand once all planes have parted them."""
        low = np.full(len(values), start, np.int64)
        high = np.full(len(values), self.n if end is None else end, np.int64)
        for k in range(self.bits):
            one = (values >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self.rank(k, low), self.rank(k, high)
            low, high = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, high - b)
        return low, high

    def count(self, values: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
        """How often each value stands in start..end-1."""
        known = (values >= 0) & (values < 1 << self.bits)
        low, high = self.spans(np.where(known, values, 0), start, end)
        return np.where(known, high - low, 0)

    def places(self, value: int) -> np.ndarray:
        """All places of the value, in order."""
        if not 0 <= value < 1 << self.bits:
            return np.empty(0, np.int64)
        low, high = self.spans(np.array([value]))
        at = np.arange(low[0], high[0])
        for k in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - k) & 1
            at = self.select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def values(self) -> np.ndarray:
        """All values in order: the planes undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            bit = self._bits(k)
            parted, out = out, np.empty(self.n, kind)
            out[np.flatnonzero(~bit)] = parted[: self.zeros[k]]
            out[np.flatnonzero(bit)] = parted[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
        return out.astype(np.uint32)


_SHARD = "part int, shard int, n_tokens long, doc_ids array<long>, ends array<long>, zeros array<long>, planes array<binary>, ones array<binary>"


def _encoded(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, int]:
    """((part, doc_id, order, tokens) of every row, number of parts): parts are ranges of (doc_id, order)."""
    key = F.coalesce("doc_id", F.lit(_NULL_ID))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    parts = max(1, min(MAX_PARTS, -(-size // PART_BYTES)))
    cuts = [k / parts for k in range(1, parts)]
    found = docs.agg(F.percentile_approx(key, cuts, max(10_000, 10 * parts)).alias("cuts")).first().cuts if cuts else []
    bounds = np.array(found or [], np.int64)

    def kernel(batches):
        own = encoder(path)
        for batch in text_slices(batches, ENCODED_BYTES):
            ids, ends = own.encode(pa.array([clean(x) for x in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string()))
            tokens = [np.append(x, end_id).astype(own.kind).tobytes() for x in np.split(ids, ends[:-1])]
            order = np.array([zlib.crc32(x) for x in tokens], np.int64)
            doc = np.array([_NULL_ID if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            # An id that fills several parts is dealt over them by `order`.
            low, high = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
            part = low + np.where(high - low > 1, order * (high - low + 1) >> 32, 0)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column("doc_id"), pa.array(order), pa.array(tokens, pa.binary())], ["part", "doc_id", "order", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(kernel, "part int, doc_id long, order long, tokens binary"), parts


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the tokens of `docs` as shards below `folder`, in ascending doc_id, null ids first.

    Null texts are empty, and each text is followed by `end_id`. Rows of one id stand in the
    order of their tokens' CRC-32, then of their tokens, so any order of the rows of `docs` gives
    the same tokens; rows that agree in all of them stay in one part. Other columns are ignored.
    """
    bound_arrow_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    told, parts = _encoded(docs, path, end_id)

    def row(part: int, shard: int, ids: list, tokens: list[np.ndarray], bits: int) -> pa.RecordBatch:
        values = np.concatenate(tokens)
        ends = np.cumsum([len(x) for x in tokens])
        zeros, planes, ones = WaveletMatrix.build(values, bits)
        cells = [part, shard, len(values), ids, ends, zeros, planes, ones]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, kinds, strict=True)], [c.split()[0] for c in _SHARD.split(", ")])

    def kernel(batches):
        own = encoder(path)
        part, shard, ids, tokens, held = 0, 0, [], [], 0
        for batch in batches:
            for p, doc_id, raw in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                some = np.frombuffer(raw, own.kind)
                if ids and (p != part or held + len(some) > shard_tokens):
                    yield row(part, shard, ids, tokens, own.bits)
                    ids, tokens, held, shard = [], [], 0, shard + 1
                part, held = p, held + len(some)
                ids.append(doc_id)
                tokens.append(some)
        if ids:
            yield row(part, shard, ids, tokens, own.bits)

    dealt = told.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "order", "tokens").select("part", "doc_id", "tokens")
    dealt.mapInArrow(kernel, _SHARD).write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_SHARD).parquet(folder)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, start): the tokens before every shard.

    Running sums in three levels: shards of a part, parts of a block of 1024, and at most
    MAX_PARTS / 1024 blocks, so no window holds more than a part's shards.
    """
    upto = lambda of, *by: F.sum(of).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.expr("part div 1024"))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n")).select("block", none(upto("n", F.lit(0), "block")).alias("before_block"))
    before = parts.withColumn("before_part", none(upto("n", "block", "part"))).join(F.broadcast(blocks), "block")
    inside = sizes.withColumn("inside", none(upto("n_tokens", "part", "shard")))
    return inside.join(before, "part").select("part", "shard", (F.col("before_block") + F.col("before_part") + F.col("inside")).alias("start"))


def _matrices(batch: pa.RecordBatch):
    """(row, matrix, ends) of every shard of a batch."""
    for k in range(batch.num_rows):
        cell = lambda name: batch.column(name)[k]  # noqa: B023, E731
        matrix = WaveletMatrix(cell("n_tokens").as_py(), cell("zeros").as_py(), cell("planes").as_py(), cell("ones").as_py())
        yield k, matrix, cell("ends").values.to_numpy()


def _documents(shards: DataFrame, column: str, figure) -> DataFrame:
    """doc_id, start, n_tokens and `figure` of the ids, of every document of the shards."""

    def kernel(batches):
        for batch in batches:
            for k, matrix, ends in _matrices(batch):
                ids, n = batch.column("doc_ids")[k].values, len(ends)
                starts = np.concatenate([[0], ends[:-1]])
                found = figure(np.split(matrix.values(), ends[:-1]))
                place = [pa.array(np.full(n, batch.column(c)[k].as_py()), pa.int32()) for c in ("part", "shard")]
                yield pa.RecordBatch.from_arrays([*place, ids, pa.array(starts), pa.array(ends - starts), found], ["part", "shard", "doc_id", "at", "n_tokens", name])

    name = column.split()[0]
    rows = shards.mapInArrow(kernel, f"part int, shard int, doc_id long, at long, n_tokens long, {column}")
    starts = shard_starts(shards)
    return rows.join(small(starts, shards.count()), ["part", "shard"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", name)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (array<int>) of every document; start counts the tokens of all documents before it."""
    return _documents(shards, "ids array<int>", lambda parts: pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))


def token_counts(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(id, n): how often each of the ids, a list within the vocabulary, stands in all shards; 0 for those that never do."""
    asked = np.unique(np.array(ids, np.int64))

    def kernel(batches):
        for batch in batches:
            for _, matrix, _ in _matrices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(matrix.count(asked))], ["id", "n"])

    found = shards.mapInArrow(kernel, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    wanted = shards.sparkSession.createDataFrame([(int(x),) for x in asked], "id long")
    return wanted.join(found, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def occurrences(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(id, doc_id, place): every occurrence of the ids, by the place within its document."""
    asked = sorted({*ids})

    def kernel(batches):
        for batch in batches:
            for k, matrix, ends in _matrices(batch):
                docs = batch.column("doc_ids")[k].values
                for x in asked:
                    at = matrix.places(x)
                    row = np.searchsorted(ends, at, "right")
                    place = at - np.concatenate([[0], ends])[row]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x)), docs.take(pa.array(row)), pa.array(place)], ["id", "doc_id", "place"])

    return shards.mapInArrow(kernel, "id long, doc_id long, place long")


def tokens_at(shards: DataFrame, positions: DataFrame, position: Column | str = "position") -> DataFrame:
    """(position, id) for every distinct position (tokens from 0) that the shards hold.

    Shards are copied to the cells of SHARD_TOKENS positions that they reach and meet the
    positions by cell; each shard's positions are then looked up in its planes.
    """
    wanted = positions.select(F.col(position).alias("position") if isinstance(position, str) else position.alias("position")).dropna().distinct()
    cell = lambda c: F.floor(c / F.lit(SHARD_TOKENS))
    reach = shards.select("part", "shard", "n_tokens").join(shard_starts(shards), ["part", "shard"]).withColumn("end", F.col("start") + F.col("n_tokens"))
    spread = reach.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))))
    placed = wanted.withColumn("cell", cell(F.col("position"))).join(spread, "cell").filter("position >= start and position < end").select(F.col("part").alias("p"), F.col("shard").alias("s"), "position", "start")

    def look(shard: pa.Table, asked: pa.Table) -> pa.Table:
        at = asked.column("position").to_numpy()
        if not len(at) or not shard.num_rows:
            return pa.table({"position": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        ((_, matrix, _),) = _matrices(shard.combine_chunks().to_batches()[0])
        return pa.table({"position": at, "id": matrix.access(at - asked.column("start").to_numpy())})

    return shards.groupBy("part", "shard").cogroup(placed.groupBy("p", "s")).applyInArrow(look, "position long, id long")


def token_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of little-endian 32-bit ids) of every row, read back from shards in the shared folder."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(docs, folder, vocabulary)
    return _documents(read_shards(spark, folder), "ids_crc32 long", lambda parts: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()))
