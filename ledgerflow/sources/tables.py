"""Tables kept as parquet change logs, safe to replay batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.upsert import last_rows
from ..session import durable

_VERSION = "batch_id"


class TableLog:
    """Rows appended per batch; the current row of a key is its latest version.

    A batch writes only the rows it changes, under its own ``batch_id`` folder:
    writing the same batch again replaces that folder, and readers inside batch
    N look at earlier batches only, so a replay gives the same tables.

    ``compact`` writes the current rows up to some batch into a ``fold`` folder
    that no batch owns. Readers then take the largest fold below the batch they
    look from and the batches behind it. Batch folders are never changed by it,
    so later batches carry on and an earlier one may still be replayed.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, struct: StructType, key: str | None):
        self.spark, self.key, self.name = spark, key, name
        self.path = f"{root}/{name}"
        self._batches, self._folds, self._done = (f"{self.path}/{part}" for part in ("batches", "folds", "folded"))
        # Files may always miss a value, whatever the table declares.
        self.struct = StructType([StructField(f.name, f.dataType) for f in struct])
        empty = spark.createDataFrame([], self.struct)
        empty.write.mode("ignore").parquet(f"{self._batches}/{_VERSION}=-1")
        self._known: list[int] | None = None
        self._void: dict[int, bool] = {}
        numbers = StructType([StructField("upto", LongType())])
        spark.createDataFrame([], numbers).write.mode("ignore").parquet(f"{self._done}/upto_of=none")

    def folds(self) -> list[int]:
        """Batches up to which complete folds exist: a few numbers, read once.

        A fold that another process makes later is not missed: the batches that
        it covers are still there.
        """
        if self._known is None:
            numbers = StructType([StructField("upto", LongType())])
            rows = self.spark.read.schema(numbers).option("recursiveFileLookup", "true").parquet(self._done)
            self._known = sorted({r.upto for r in rows.collect()})
        return self._known

    def append(self, rows: DataFrame, batch_id: int) -> None:
        self._void.clear()
        rows.select(*self.struct.names).write.mode("overwrite").option("compression", "zstd").parquet(f"{self._batches}/{_VERSION}={batch_id}")

    def written(self, batch_id: int) -> DataFrame:
        """The rows of one batch, read back."""
        return self.spark.read.schema(self.struct).parquet(f"{self._batches}/{_VERSION}={batch_id}")

    def is_void(self, before: int) -> bool:
        """Whether no batch before this one wrote a row."""
        if before not in self._void:
            rows = self.spark.read.schema(StructType([*self.struct.fields, StructField(_VERSION, LongType())])).parquet(self._batches)
            self._void[before] = not any(n < before for n in self.folds()) and rows.where(F.col(_VERSION) < before).isEmpty()
        return self._void[before]

    def versions(self, before: int | None = None) -> DataFrame:
        """Row versions with their ``batch_id``, up to but excluding ``before``; folded ones carry the fold's number."""
        schema = StructType([*self.struct.fields, StructField(_VERSION, LongType())])
        if before is not None and self.is_void(before):
            # The optimizer drops joins with a table that holds nothing yet.
            return self.spark.createDataFrame([], schema).where(F.lit(False))
        rows = self.spark.read.schema(schema).parquet(self._batches)
        if before is not None:
            rows = rows.where(F.col(_VERSION) < before)
        usable = [n for n in self.folds() if before is None or n < before]
        if not usable:
            return rows
        upto = usable[-1]
        folded = self.spark.read.schema(self.struct).parquet(f"{self._folds}/fold={upto}")
        return rows.where(F.col(_VERSION) > upto).unionByName(folded.withColumn(_VERSION, F.lit(upto).cast("long")))

    def newest(self) -> int:
        """The largest batch number, -1 for none."""
        return self.spark.read.schema(StructType([*self.struct.fields, StructField(_VERSION, LongType())])).parquet(
            self._batches
        ).agg(F.coalesce(F.max(_VERSION), F.lit(-1))).first()[0]

    def current(self, before: int | None = None, only: DataFrame | None = None, on: str | None = None) -> DataFrame:
        """The current rows, optionally only those whose ``on`` column is listed in ``only``.

        With a column other than the key, the keys that ever carried a listed
        value are looked up first, so that all of their versions are compared.
        """
        rows = self.versions(before)
        if self.key is None:
            return rows.select(*self.struct.names)
        if before is not None and self.is_void(before):
            return rows.select(*self.struct.names)
        on = on or self.key
        if only is not None:
            listed = only.select(on).distinct()
            if on != self.key:
                listed = rows.join(listed, on, "left_semi").select(self.key).distinct()
            rows = durable(rows.join(listed, self.key, "left_semi"), "listed")
        return last_rows(rows, self.key, _VERSION).select(*self.struct.names)

    def compact(self, upto: int) -> None:
        """Fold all versions up to batch ``upto``; refused for the newest batch, which may yet be replayed."""
        if upto >= self.newest():
            raise ValueError(f"{self.name}: batch {upto} is the newest and may be replayed; fold up to an earlier one")
        self.current(upto + 1).write.mode("overwrite").option("compression", "zstd").parquet(f"{self._folds}/fold={upto}")
        number = self.spark.createDataFrame([(upto,)], "upto long").coalesce(1)
        number.write.mode("overwrite").parquet(f"{self._done}/upto_of={upto}")
        self._known = sorted({*self.folds(), upto})


class Positions:
    """One order for the batches of all streams that write to a root.

    A stream names itself by an id that lies beside its checkpoint. The first
    time a batch of it is seen it gets the next free position, which is what
    table logs know as its batch number; a replay finds the same one, and a
    second stream's batch 0 never meets the first one's. One batch at a time may
    be written to a root.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/_positions"
        self.struct = StructType([StructField("stream", StringType()), StructField("batch", LongType()), StructField("position", LongType())])
        spark.createDataFrame([], self.struct).write.mode("ignore").parquet(f"{self.path}/first")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.struct).option("recursiveFileLookup", "true").parquet(self.path)

    def of(self, stream: str, batch: int) -> int:
        mine = (F.col("stream") == stream) & (F.col("batch") == batch)
        found = self.all().agg(F.max(F.when(mine, F.col("position"))).alias("mine"), F.max("position").alias("top")).first()
        if found.mine is not None:
            return found.mine
        position = 0 if found.top is None else found.top + 1
        row = self.spark.createDataFrame([(stream, batch, position)], self.struct).coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/p={position}")
        return position


def stream_identity(spark: SparkSession, checkpoint: str, fresh: str) -> str:
    """The id kept beside a checkpoint; ``fresh`` becomes it where there is none yet."""
    path = f"{checkpoint.rstrip('/')}-stream"
    spark.createDataFrame([(fresh,)], "id string").coalesce(1).write.mode("ignore").parquet(path)
    return spark.read.schema("id string").parquet(path).first().id
