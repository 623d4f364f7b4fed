"""What the corpus operators share: tables, the shared work folder, document chunks and byte helpers."""

from __future__ import annotations

import math
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one chunk of documents holds on average.
CHUNK_BYTES = 4 << 20
#: A chunk holds about this many documents where texts are short.
CHUNK_DOCS = 200
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 500
#: Parts of the screens that tell which rows' texts must move, and longs of a part: 8 MB in all. Beyond some 20 million ids a screen lets
#: more and more other rows pass, which costs their way and nothing else.
SCREEN_PARTS, SCREEN_WORDS = 64, 1 << 14
_PART_BITS = 6
#: ASCII white space, as the contracts name it: [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"
#: bytes.translate table that lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, as spark.checkpoint.dir names it. A local session without the setting gets a folder of its own;
    on a cluster a machine's own folder would not do, so there the setting must be there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts its lineage in a way that outlives executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialise() wrote, once nothing reads them any more."""
    for t in tables:
        path = getattr(t, "_work_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def id_hash(doc_id: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"))


def screen_of(table: DataFrame, key: Column) -> DataFrame:
    """A Bloom filter in blocks over a 64-bit hash of a table's rows: SCREEN_PARTS rows (screen part, screen bits: an array of SCREEN_WORDS longs), whose
    size does not depend on the table. The highest bits of a hash choose its part, two other slices of it its bits there."""
    mask = 64 * SCREEN_WORDS - 1
    rows = table.select(key.alias("h")).selectExpr(f"cast(shiftrightunsigned(h, {64 - _PART_BITS}) as int) AS part", f"explode(array(h & {mask}L, shiftrightunsigned(h, 20) & {mask}L)) AS at")
    words = rows.selectExpr("part", "cast(shiftrightunsigned(at, 6) as int) AS i", "shiftleft(1L, cast(at & 63 as int)) AS bit")
    every = table.sparkSession.range(SCREEN_PARTS * SCREEN_WORDS).selectExpr(f"cast(id div {SCREEN_WORDS} as int) AS part", f"cast(id % {SCREEN_WORDS} as int) AS i", "0L AS bit")
    every = words.unionAll(every).groupBy("part", "i").agg(F.bit_or("bit").alias("word"))
    return every.groupBy(F.col("part").alias("screen part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias("screen bits"))  # SCREEN_WORDS each


def passes(doc_id: Column) -> Column:
    """Whether the screen may have a doc_id: the condition of a join with it; not met only if the screen does not have it."""
    h, mask = id_hash(doc_id), 64 * SCREEN_WORDS - 1
    part = F.shiftrightunsigned(h, 64 - _PART_BITS).cast("int")

    def held(at):
        word = F.get(F.col("screen bits"), F.shiftrightunsigned(at, 6).cast("int"))
        return F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return (part == F.col("screen part")) & held(h.bitwiseAND(F.lit(mask))) & held(F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(mask)))


def split_rows(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose doc_id is certainly not among ``ids``, and the others, told apart where they are read: no text moves.

    The screen has a fixed 8 MB at any size; with very many ids it lets more rows pass and loses none."""
    screen = F.broadcast(materialise(screen_of(ids, id_hash(F.col("doc_id"))), "screen"))
    met = passes(F.col("doc_id"))
    return docs.join(screen, met, "left_anti"), docs.join(screen, met, "left_semi")


def drop_rows(docs: DataFrame, gone: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """docs without the rows whose doc_id (null equals null) is in ``gone``, which is written first; ``also`` names further columns of
    gone and what they must equal. Only rows that a screen lets pass are joined, so the other texts stay where they are read."""
    also = also or {}
    gone = materialise(gone.select(F.col("doc_id").alias("gone id"), *[F.col(c).alias(f"gone {c}") for c in also]).distinct(), "gone")
    rest, near = split_rows(docs, gone.select(F.col("gone id").alias("doc_id")))
    for c, value in also.items():
        near = near.withColumn(f"own {c}", value)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone id"))
    for c in also:
        same = same & (F.col(f"own {c}") == F.col(f"gone {c}"))
    return rest.unionByName(near.join(gone, same, "left_anti").select(docs.columns))


def small_batches(spark: SparkSession) -> None:
    """Texts travel to Python BATCH_ROWS at a time, unless the session has its own setting: a batch of long texts must fit a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, BATCH_ROWS)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def chunk_count(docs: DataFrame) -> int:
    """Chunks for these documents: one for each CHUNK_BYTES of text, more where there are many short documents."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return max(1, math.ceil((size or 0) / CHUNK_BYTES), min(256, math.ceil((n or 0) / CHUNK_DOCS)))


def chunk_of(doc_id: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(chunks)).cast("int")


def crc_mod(doc_id: int, m: int) -> int:
    """crc32 of the id as text, modulo m: the fixed folds of the learned operators."""
    return zlib.crc32(str(doc_id).encode()) % m


def crc_mod_col(doc_id: Column, m: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m)).cast("int")


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of each value of an Arrow string column; null gives an empty text."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(sizes: list[int], limit: int):
    """Slices of consecutive items whose sizes sum to about limit; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sorted_runs(batches, keys: list[str], least: int = 20_000):
    """From sorted Arrow batches, tables of whole runs of equal keys with at least ``least`` rows where there are so many.

    A run that goes on in the next batch is held back until it ends."""
    import pyarrow as pa

    held: list = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[rows - 1].as_py() for k in keys]
        low, high = 0, rows - 1  # first row with the last key
        while low < high:
            mid = (low + high) // 2
            if [table.column(k)[mid].as_py() for k in keys] == last:
                high = mid
            else:
                low = mid + 1
        if low:
            yield table.slice(0, low).combine_chunks()
        held = table.slice(low).to_batches()
        rows -= low
        least = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def run_bounds(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in sorted columns, and the number of rows at the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)
