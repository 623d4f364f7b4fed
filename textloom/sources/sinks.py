"""Writers: JSON in shards by key or by range, manifests, vector tables, and writes that can be repeated."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import zero_pad


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session without the setting gets a folder of its own; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(df: DataFrame) -> DataFrame:
    """df through a table in the cluster's shared folder: a cut in lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Compact JSON, one record a line, characters as they are."""
    df.write.mode(mode).json(path)


def shard_by_key(df: DataFrame, key: Column, path: str, width: int = 3, mode: str = "overwrite") -> None:
    """One folder for each key, padded with zeros. Rows of a key are brought together, a large key in several files."""
    df.withColumn("shard", zero_pad(key, width)).repartition("shard").write.mode(mode).partitionBy("shard").json(path)


def range_map(df: DataFrame, serial: str, size: int = 1000, name: str = "shard_%05d.json") -> DataFrame:
    """start, end, file of blocks of ``size`` serial numbers, for those that have rows."""
    block = F.floor((F.col(serial) - 1) / size)
    rows = df.groupBy(block.alias("block")).agg(F.min(serial).alias("start"), F.max(serial).alias("end"))
    head, tail = name.split("%05d")
    return rows.select("start", "end", F.concat(F.lit(head), zero_pad(F.col("block") + 1, 5), F.lit(tail)).alias("file"))


def shard_by_range(df: DataFrame, serial: str, path: str, size: int = 1000, mode: str = "overwrite") -> DataFrame:
    """Blocks of serial numbers, sorted within a block; returns the range map."""
    block = F.floor((F.col(serial) - 1) / size)
    df.withColumn("block", block).repartitionByRange("block").sortWithinPartitions("block", serial).write.mode(mode).partitionBy("block").json(path)
    return range_map(df, serial, size)


def manifest(counts: dict[str, DataFrame], means: dict[str, tuple[str, Column]] | None = None, **facts) -> DataFrame:
    """One row: the number of rows of each table, means (name: the table and what is averaged over it), and facts as they are."""
    out = None
    for name, df in counts.items():
        own = [F.round(F.avg(c), 6).alias(n) for n, (t, c) in (means or {}).items() if t == name]
        one = df.agg(F.count(F.lit(1)).alias(name), *own)
        out = one if out is None else out.crossJoin(one)  # single rows
    return out.withColumns({k: F.lit(v) for k, v in facts.items()})


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function from names to its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def staged(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes df beside its place and moves it there whole, so that a run that is killed leaves what was there, or nothing."""
    fs, at = _files(df.sparkSession, path)
    draft, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("draft", "old"))
    df.write.partitionBy(*partition_by or []).parquet(draft)
    replaced = fs.exists(at(path))
    if replaced and not fs.rename(at(path), at(old)) or not fs.rename(at(draft), at(path)):
        raise OSError(f"{draft} could not become {path}")
    if replaced:
        fs.delete(at(old), True)


def write_idempotent(df: DataFrame, path: str, force: bool = False, dry_run: bool = False) -> str:
    """'written', 'skipped' (it is there and force is off) or 'planned' (dry run). What is written appears whole."""
    from textloom.sources.readers import exists

    if exists(df.sparkSession, path) and not force:
        return "skipped"
    if dry_run:
        return "planned"
    staged(df, path)
    return "written"


class ItemStore:
    """Items by key in batches, each with a record of what became of every item. A batch is one folder that appears whole; of an item that
    several batches wrote the last counts."""

    SCHEMA = "item string, content string, status string, batch int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        fs, at = _files(spark, path)
        fs.mkdirs(at(path))

    def records(self) -> DataFrame:
        """item, content (of written ones), status, batch: one row for each item of each batch."""
        return self.spark.read.schema(self.SCHEMA).option("pathGlobFilter", "*.parquet").parquet(self.path)

    def items(self) -> DataFrame:
        """item, content: what is in the store."""
        return self.records().where("status = 'written'").groupBy("item").agg(F.max_by("content", "batch").alias("content"))

    def put(self, items: DataFrame, force: bool = False) -> DataFrame:
        """Adds a batch of items (item, content) and returns its records. An item that is in the store is skipped unless ``force``; one whose
        content is null or blank has failed; of an item that comes twice the least content is taken."""
        fs, at = _files(self.spark, self.path)
        batch = 1 + max((int(f.getPath().getName()[6:]) for f in fs.listStatus(at(self.path)) if f.getPath().getName().startswith("batch=")), default=0)
        rows = items.groupBy(F.col("item").cast("string").alias("item")).agg(F.min(F.when(F.trim("content") != "", F.col("content"))).alias("content"))
        there = self.items().select("item", F.lit(True).alias("there"))
        rows = rows.join(there, "item", "left").withColumn("skip", F.coalesce("there", F.lit(False)) & F.lit(not force))
        status = F.when(F.col("skip"), "skipped").when(F.col("content").isNull(), "failed").otherwise("written")
        draft = f"{self.path}.draft-{uuid.uuid4().hex}"
        rows.select("item", F.when(status == "written", F.col("content")).alias("content"), status.alias("status")).write.parquet(draft)
        if not fs.rename(at(draft), at(f"{self.path}/batch={batch}")):
            raise OSError(f"batch {batch} of {self.path} is there already")
        return self.records().where(F.col("batch") == batch)

    def counts(self) -> DataFrame:
        """batch, written, skipped, failed."""
        return self.records().groupBy("batch").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("written", "skipped", "failed")])


def vector_table(records: DataFrame, vectors: dict[str, str], payload: list[str], path: str) -> None:
    """A table that stands for a collection: point_id, a vector column each, and a payload struct. It replaces what is there."""
    records.select("point_id", *[F.col(c).alias(name) for name, c in vectors.items()], F.struct(*payload).alias("payload")).write.mode("overwrite").parquet(path)


def upsert_batches(records: DataFrame, send, size: int = 256) -> DataFrame:
    """Hands records to a vector store in batches: send(rows) gets up to ``size`` of them as dictionaries and may be called again with the
    same ones after a failure, so it must replace what has the same point_id. Returns batch sizes."""
    names = records.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            done = []
            for low in range(0, b.num_rows, size):
                rows = b.slice(low, size).to_pylist()
                send([{k: r[k] for k in names} for r in rows])
                done.append(len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], ["n"])

    return records.mapInArrow(run, "n int")


def nested_pairs(pairs: DataFrame) -> DataFrame:
    """anchor_id and a map from pair type to its list of (id, score, shared), best first. pairs: anchor_id, pair_type, cand_id, score, shared, rank."""
    item = F.struct("rank", F.struct(F.col("cand_id").alias("id"), "score", "shared").alias("p"))
    lists = pairs.groupBy("anchor_id", "pair_type").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["p"]).alias("items"))
    return lists.groupBy("anchor_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pair_type", "items")))).alias("pairs"))
