"""Incremental deliveries with Structured Streaming: files that arrive are taken in once, repeats are dropped, counts follow late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siglot.sources.files import scratch


def _stream(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    folder, _, name = path.rstrip("/").rpartition("/")
    first = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").first()
    alone = first is not None and first.path.rpartition("/")[2] == name
    read = spark.readStream.schema(schema).option("pathGlobFilter", name if alone else "*.parquet")
    read = read.option("maxFilesPerTrigger", files) if files else read
    return read.parquet(folder) if alone else read.option("recursiveFileLookup", "true").parquet(path)


def ingest(spark: SparkSession, path: str, schema: StructType, key: list[str]) -> DataFrame:
    """All rows delivered so far, one per key: each batch appends the rows whose key the table doesn't hold yet. A batch that runs again writes over what it wrote."""
    at = scratch(spark)

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(key)
        if number:
            held = spark.read.schema(schema).parquet(*[f"{at}/rows/{k}" for k in range(number)])
            new = new.join(held.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{at}/rows/{number}")

    q = _stream(spark, path, schema).writeStream.foreachBatch(merge).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/rows")


#: About so many rows of a period go to one task and file.
MOST_ROWS = 500_000


class VersionedTable:
    """Deliveries by period, where a later one takes the place of an earlier one, in a folder that all executors share.

    Each period that a batch touches is written anew beside its older versions, and a
    log of one small file a batch then says which version of a period counts. The
    log's write is the only switch: readers see a batch wholly or not at all, a batch
    that runs again writes the same files and the same log entry, and periods that
    a batch doesn't touch are neither read nor written.
    """

    def __init__(self, spark: SparkSession, at: str, schema: StructType, key: list[str], period: str, delivered: str):
        self.spark, self.at, self.schema, self.key, self.period, self.delivered = spark, at, schema, key, period, delivered
        self.kind = schema[period].dataType.simpleString()

    def _log(self, before: int) -> list:
        """The version that counts of each period, from the batches under `before`: a short list."""
        if before <= 0:
            return []
        log = self.spark.read.schema(f"period {self.kind}, batch int, delivered string").parquet(*[f"{self.at}/log/batch={k}" for k in range(before)])
        return log.groupBy("period").agg(F.max("batch").alias("batch")).collect()

    def _rows(self, versions: list, periods: list | None = None) -> DataFrame | None:
        paths = [f"{self.at}/rows/batch={r['batch']}" for r in versions if periods is None or r["period"] in periods]
        if not paths:
            return None
        newest = self.spark.createDataFrame([(r["period"], r["batch"]) for r in versions if periods is None or r["period"] in periods], f"_period {self.kind}, _batch int")
        held = self.spark.read.option("basePath", f"{self.at}/rows").parquet(*[f"{self.at}/rows/batch={k}/part_of={self._name(p)}" for p, k in ((r["period"], r["batch"]) for r in versions if periods is None or r["period"] in periods)])
        return held.join(F.broadcast(newest), (F.col(self.period) == F.col("_period")) & (F.col("batch") == F.col("_batch"))).select(self.schema.names)

    @staticmethod
    def _name(period) -> str:
        import hashlib

        return hashlib.sha256(str(period).encode()).hexdigest()[:16]

    def merge(self, batch: DataFrame, number: int, cumulative: bool = True) -> list:
        """Takes in a batch of deliveries and returns the periods it touched.

        cumulative: a period's latest delivery holds all its rows, so it replaces what
        earlier ones held, and an earlier one that comes late changes nothing. If not,
        rows are added, and of rows with one key those of the latest delivery stay.
        """
        sizes = batch.where(F.col(self.period).isNotNull()).groupBy(self.period).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a period
        touched = [r[0] for r in sizes]
        spread = max([1, *(-(-r["n"] // MOST_ROWS) for r in sizes)])
        held = self._rows(self._log(number), touched)
        every = batch if held is None else held.unionByName(batch.select(self.schema.names))
        every = every.where(F.col(self.period).isNotNull())
        if cumulative:  # a period may hold most rows, so its latest delivery is aggregated, and no window gathers it
            newest = every.groupBy(F.col(self.period).alias("_of")).agg(F.max(self.delivered).alias("_newest"))
            now = every.join(F.broadcast(newest), F.col(self.period) == F.col("_of")).drop("_of")
        else:
            now = every.withColumn("_newest", F.max(self.delivered).over(Window.partitionBy(self.period, *self.key)))
        now = now.where(F.col(self.delivered) == F.col("_newest")).drop("_newest").dropDuplicates([self.period, *self.key])
        name = F.substring(F.sha2(F.col(self.period).cast("string"), 256), 1, 16)
        now.withColumn("part_of", name).repartition("part_of", F.pmod(F.xxhash64(*self.key), F.lit(spread))).write.mode("overwrite").partitionBy("part_of").parquet(f"{self.at}/rows/batch={number}")
        log = self.spark.createDataFrame([(p, number, "") for p in touched], f"period {self.kind}, batch int, delivered string")
        log.write.mode("overwrite").parquet(f"{self.at}/log/batch={number}")
        self.batches = number + 1
        return touched

    def read(self, batches: int | None = None) -> DataFrame:
        """The rows that count after so many batches."""
        rows = self._rows(self._log(self.batches if batches is None else batches))
        return rows if rows is not None else self.spark.createDataFrame([], self.schema)


def ingest_versions(spark: SparkSession, path: str, schema: StructType, key: list[str], period: str, delivered: str, cumulative: bool = True, files: int = 1) -> DataFrame:
    """The rows that count of all files delivered under path, taken in as a stream of `files` files a batch."""
    at = scratch(spark)
    table = VersionedTable(spark, at, schema, key, period, delivered)
    q = _stream(spark, path, schema, files).writeStream.foreachBatch(lambda batch, number: table.merge(batch, number, cumulative) and None).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return table.read()


def daily_counts(spark: SparkSession, path: str, schema: StructType, late: str = "7 days") -> DataFrame:
    """day, event_type, n over the stream, with a watermark for late rows; each batch's changed windows are written, and the last state of a window counts."""
    at = scratch(spark)
    s = _stream(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    n = s.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "n").write.mode("overwrite").parquet(f"{at}/counts/batch={number}")

    q = n.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/counts").groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))
