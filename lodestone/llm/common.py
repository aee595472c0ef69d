"""Helpers shared by the corpus operators: shared storage, tokens, samples."""

from __future__ import annotations

import gc
import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: blank and 0x09 to 0x0D.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: A character that belongs to a word.
WORD_CHAR = r"[^\x20\x09-\x0D]"
#: Bytes of text that one slice of an Arrow batch may hold, one row at least.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine (tests) one is made;
    on a cluster a machine-local folder would be wrong, and this is an error."""
    own = "lodestone.shared.dir"
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(own, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set(own, found)
    return found.rstrip("/")


#: Rows of a file, where a table's number of rows is known before.
FILE_ROWS = 1 << 17


class Stored:
    """A table written to the shared folder: lineage ends there.

    What an operator still reads when it returns can't be deleted by it:
    ``drop_stored`` does so, once results are written elsewhere."""

    kept: list[Stored] = []

    def __init__(self, df: DataFrame, name: str, most: int | None = None):
        """``most``: rows that it has at the most, where few tasks are to write
        few rows; each that writes a file may start processes (local files)."""
        if most is not None:
            df = df.coalesce(max(1, -(-most // FILE_ROWS)))
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema
        Stored.kept.append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files, once nothing reads them any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        Stored.kept = [x for x in Stored.kept if x is not self]


def drop_stored(spare: set[str] = frozenset()) -> None:
    """Delete all stored tables but those whose paths are in ``spare``."""
    for x in [x for x in Stored.kept if x.path not in spare]:
        x.drop()


def with_rid(df: DataFrame, name: str) -> Stored:
    """The rows stored as ``rid``, a number of their own, and the struct
    ``row``: ids may be null or repeat, and a number is only good where it is
    not made again."""
    return Stored(df.select(F.monotonically_increasing_id().alias("rid"), whole_row(df).alias("row")), name)


#: Keys that may travel with the tasks because they have many rows each.
MOST_HOT = 10_000


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int, most: int = MOST_HOT) -> DataFrame:
    """An inner join of ``rows`` to ``facts``, one row a key, where ``count``
    says how many rows a key has, of ``total``. Keys with more than one row in
    ``most``, of which there are at most that many, are broadcast, so that no
    task gets a hot key's rows."""
    hot = facts[count] > total // most
    many = facts.where(hot)
    met = rows.join(F.broadcast(many), keys)
    rest = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti")
    return met.unionByName(rest.join(facts.where(~hot), keys))


#: Bits of a bitmap, at the most: 64 MB.
MOST_BITS = 29


def bitmap(hashes: DataFrame, n: int):
    """Broadcast a bitmap by the low bits of column ``h``, 16 bits for each of
    ``n`` values as far as it goes; it is combined by words, of which there is
    a bounded number. It may let too much through but never too little."""
    size = min(MOST_BITS, max(12, (16 * max(1, n)).bit_length()))
    at = F.col("h").bitwiseAND(F.lit((1 << size) - 1))
    words = hashes.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    if words.num_rows:
        out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over: it does so
    when the driver's garbage is collected, which may be long after the disks
    of the executors are full. Spark's listeners hold on to the last step until
    they are told of another."""
    gc.collect()
    spark.sql("SELECT 1").collect()
    with suppress(Py4JError):  # still busy after 10 s
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.sparkContext._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def word_array(c: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WORD_BREAK), "")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once for each row.

    A plain ``withColumn`` may be inlined wherever the column is used, and so
    run again for every use; the optimiser doesn't inline a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that working columns clash with none."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about ``most`` bytes."""
    for batch in batches:
        sizes = [len_ or 0 for len_ in pc.binary_length(batch.column(text)).to_pylist()]
        start = size = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(sizes):
            yield batch.slice(start)


def labelled_sample(labels: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` labelled ids at the most, one row each, chosen by hash.

    Columns doc_id, quality (the least given) and toxic (the greatest given);
    rows without an id or a quality are no labels."""
    one = (
        labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col(key).alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).cast("int").alias("toxic"))
    )
    n = one.count()
    if n <= most:
        return one
    share = int(most / n * (1 << 31))
    return one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < share)
