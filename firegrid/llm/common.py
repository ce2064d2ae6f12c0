"""Helpers shared by the training-data operators.

Everything here is DataFrame code; `drop_rows` and `repeat_filter` rest on one idea: a
hashed bit map of bounded size is broadcast, rows it rules out pass straight on, and only
the rest are shuffled for an exact decision.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Bits of a broadcast bit map at most: 2**28 bits are 32 MB, whatever the input's size.
MAX_FILTER_BITS = 1 << 28
#: Rows of a small table that may be broadcast.
MAX_BROADCAST_ROWS = 50_000
#: Bytes of an Arrow batch at most, where the session does not set its own bound. A batch lies in
#: memory several times (as rows, as vectors on both sides, as Python objects), once for each task.
ARROW_BATCH_BYTES = 8 << 20


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has: `name`, with underscores after it where it is taken (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while any(c == name.lower() or c.startswith(f"{name.lower()}_") for c in taken):
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; one of our own only where none is set and Spark runs in one process."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="firegrid-checkpoint-")
        context.setCheckpointDir(shared)
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables that one run writes to the shared folder and reads back, and drops once their successors are written.

    Unlike checkpoints they are compressed and read by column, and their space is given back.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", {}

    def keep(self, name: str, df: DataFrame, file_rows: int = 0) -> DataFrame:
        """The table as written, in files of at most `file_rows` rows: arrays are decoded up to 4096 rows of a file at once, however large."""
        self.paths[name] = f"{self.root}/{name}"
        df.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def read(self, *names: str) -> DataFrame:
        """The rows of those tables that were kept."""
        return self.spark.read.parquet(*(self.paths[name] for name in names if name in self.paths))

    def drop(self, *names: str) -> None:
        """Nothing that is still to be computed may read these tables."""
        for path in [self.paths.pop(name) for name in names if name in self.paths]:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def bound_arrow_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless its user did: whole texts differ widely in length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_BATCH_BYTES)


def text_slices(batches, size: int = 2 << 20):
    """The Arrow batches cut into slices of about `size` bytes of the column `text`; a longer text is a slice's last."""
    for batch in batches:
        through = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
        cut = np.flatnonzero(np.diff(through // size)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def release_memory() -> None:
    """Give a worker's unused memory back, Arrow's own and that of numpy and Python: workers outlive their tasks, and share an executor's memory."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose counted rows are few, else leave the choice to Spark."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


#: Keys with more than this part of the rows are hot; there are fewer of them than HOT_SHARE. Tasks that a hot key is dealt over.
HOT_SHARE, SALTS = 256, 64


def hot_keys(counts: DataFrame, key: str, rows: int, number: str = "count") -> list[int]:
    """Hashes of the keys of `counts` (key, number) with over rows / HOT_SHARE of all rows: fewer than HOT_SHARE numbers."""
    found = counts.filter(F.col(number) > max(16, rows // HOT_SHARE)).select(F.xxhash64(key).alias("h")).distinct()
    return sorted(r.h for r in found.collect())


def spread_join(rows: DataFrame, groups: DataFrame, key: str, hot: list[int], by: str, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row a key) on `key`; each of the few `hot` keys is dealt over SALTS tasks.

    A hot key's rows are told apart by a hash of their column `by`, and its row in groups
    is repeated for each salt. A key whose hash collides with a hot one is salted too.
    """
    if not hot:
        return rows.join(groups, key, how)
    is_hot, salt = F.xxhash64(key).isin(hot), fresh("_salt", rows, groups)
    salted = rows.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(by, F.lit(9)), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(groups.withColumn(salt, F.explode(copies)), [key, salt], how).drop(salt)


def filter_bits(rows: int, per_row: int = 16) -> int:
    """A power of two of about `per_row` bits a row, within MAX_FILTER_BITS."""
    return max(1 << 15, min(MAX_FILTER_BITS, 1 << max(0, rows * per_row - 1).bit_length()))


def cell(key: Column, bits: int, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit(bits - 1))


def bit_map(cells: DataFrame) -> DataFrame:
    """(bucket, bits): the column `cell` of `cells` as 4 KB bit maps."""
    return (
        cells.select(F.bitmap_bucket_number("cell").alias("bucket"), F.bitmap_bit_position("cell").alias("at"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
    )


def bit_is_set(bits: Column, cell_number: Column) -> Column:
    at = F.bitmap_bit_position(cell_number)
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def marked(df: DataFrame, maps: DataFrame, cell_number: Column, name: str) -> DataFrame:
    """Add the boolean `name`: whether the bit of `cell_number` is set in the broadcast `maps`."""
    side = F.broadcast(maps.select(F.col("bucket").alias(f"{name}_bucket"), F.col("bits").alias(f"{name}_bits")))
    return (
        df.join(side, F.bitmap_bucket_number(cell_number) == F.col(f"{name}_bucket"), "left")
        .withColumn(name, bit_is_set(F.col(f"{name}_bits"), cell_number))
        .drop(f"{name}_bucket", f"{name}_bits")
    )


def repeat_filter(df: DataFrame, key: str, rows: int, name: str = "maybe_repeated") -> DataFrame:
    """Mark the rows whose `key` possibly occurs twice or more; unmarked keys occur once.

    First pass: each key hits two cells, and cells hit twice or more make the bit map.
    Second pass: a row is marked if both its cells are in the map. Only cell numbers are
    shuffled, after partial counts.
    """
    bits = filter_bits(rows)
    cells = [cell(F.col(key), bits, seed) for seed in (1, 2)]
    hit = df.select(F.explode(F.array(*cells)).alias("cell")).groupBy("cell").count().filter("count > 1")
    maps = checkpoint(bit_map(hit))
    both = marked(marked(df, maps, cells[0], f"{name}_1"), maps, cells[1], f"{name}_2")
    return both.withColumn(name, F.col(f"{name}_1") & F.col(f"{name}_2")).drop(f"{name}_1", f"{name}_2")


def possible_ids(docs: DataFrame, ids: DataFrame, key: str, name: str = "possible") -> DataFrame:
    """Mark the rows of `docs` whose `key` is possibly among `ids` (a written or checkpointed table)."""
    bits = filter_bits(ids.count())
    return marked(docs, bit_map(ids.select(cell(F.col(key), bits, 1).alias("cell")).distinct()), cell(F.col(key), bits, 1), name)


def drop_rows(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """`docs` without the rows whose key is in `ids`; only possible hits are shuffled."""
    mark = fresh("possible", docs)
    seen = possible_ids(docs, ids, key, mark)
    straight = seen.filter(~F.col(mark)).drop(mark)
    checked = seen.filter(mark).drop(mark).join(ids.select(key), key, "left_anti")
    return straight.unionByName(checked.select(straight.columns))


def keep_rows(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose key is in `ids`; only possible hits are shuffled."""
    mark = fresh("possible", docs)
    return possible_ids(docs, ids, key, mark).filter(mark).drop(mark).join(ids.select(key), key, "left_semi").select(docs.columns)
