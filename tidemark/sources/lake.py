"""The Parquet lake: immutable files in commits, a log that says which count, and reads that let later commits replace what they cover.

path/data/commit=<id>/dataset=../year=../month=../*.parquet holds rows, path/cover/commit=<id> the
(dataset, unit, day) keys of a commit with their numbers of rows, path/log/<number>.json makes it count. A
write only adds files, so a month is not rewritten when rows come for it, several writers
of one month do not disturb each other, and a write that dies before its log entry leaves nothing that
is read. Of commits with one key the last hides the rows of those before. compact merges
months that many commits hold; vacuum deletes files that nothing reads.

The store must create a file only where there is none, as HDFS does: that gives commits their numbers.
"""
from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

PARTITIONS = ("dataset", "year", "month")
DAY_OF, ROWS = "__day", "__rows"


@dataclass(frozen=True)
class Commit:
    """order: whose rows hide whose; a compaction takes the place of the last commit it read."""
    number: int
    id: str
    order: int
    unit: tuple[str, ...]
    at: str
    schema: StructType
    drops: tuple[tuple, ...] = ()  # (commit, dataset, year, month) that this one holds in place of others


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def log(spark: SparkSession, path: str) -> list[Commit]:
    """All commits by number. An entry that is not whole yet does not count."""
    fs, folder = _fs(spark, f"{path}/log")
    if not fs.exists(folder):
        return []
    out = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if not name.endswith(".json"):
            continue
        stream = fs.open(status.getPath())
        try:
            e = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            continue
        finally:
            stream.close()
        out.append(Commit(int(name[:-5]), e["commit"], e["order"] if e["order"] is not None else int(name[:-5]), tuple(e["unit"]), e["at"], StructType.fromJson(e["schema"]), tuple(map(tuple, e["drops"]))))
    return sorted(out, key=lambda c: c.number)


def _publish(spark: SparkSession, path: str, commit: str, unit: Sequence[str], at: str, schema: StructType, order: int | None = None, drops: Iterable[Sequence] = ()) -> None:
    """Takes the next free number; until then nothing of the commit counts, and then all of it does."""
    body = json.dumps({"commit": commit, "order": order, "unit": list(unit), "at": at, "schema": schema.jsonValue(), "drops": [list(d) for d in drops]})
    fs, folder = _fs(spark, f"{path}/log")
    fs.mkdirs(folder)
    while True:
        taken = [int(n[:-5]) for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json")]
        target = f"{path}/log/{max(taken, default=0) + 1:012d}.json"
        if fs.getUri().getScheme() == "file":
            # The local file system of Hadoop looks and then writes; a link is made or fails.
            local = urlparse(target).path
            spare = f"{local}.{commit}"
            with open(spare, "w") as f:
                f.write(body)
            try:
                os.link(spare, local)
                return
            except FileExistsError:
                continue
            finally:
                os.remove(spare)
        try:
            out = fs.create(_fs(spark, target)[1], False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                continue
            raise
        out.write(bytearray(body, "utf-8"))
        out.close()
        return


def _meet(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(Column.__and__, [x.eqNullSafe(y) for x, y in zip(a, b)])


def _store(rows: DataFrame, path: str, at: str, unit: Sequence[str], commit: str) -> DataFrame:
    """Writes a commit's rows and their cover, and gives the cover. Files are cut by size, and statistics on unit and stamp prune reads."""
    spark = rows.sparkSession
    new = rows.withColumn("year", F.year(at)).withColumn("month", F.month(at))
    (new.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, *unit, at)
     .write.option("compression", "zstd").option("maxRecordsPerFile", 50_000_000).partitionBy(*PARTITIONS).parquet(f"{path}/data/commit={commit}"))
    held = spark.read.schema(new.schema).parquet(f"{path}/data/commit={commit}")
    cover = held.groupBy(*PARTITIONS, *unit, F.to_date(at).alias(DAY_OF)).agg(F.count(F.lit(1)).alias(ROWS))
    cover.coalesce(8).write.parquet(f"{path}/cover/commit={commit}")
    return spark.read.parquet(f"{path}/cover/commit={commit}")


def write(rows: DataFrame, path: str, at: str = "t", unit: Sequence[str] = ("symbol",)) -> None:
    """Adds rows, which replace what they cover by dataset, unit and day, and nothing else.

    A null stamp, dataset or unit is a value as any other. A column keeps its type in all writes, and a lake its unit.
    """
    spark, before = rows.sparkSession, log(rows.sparkSession, path)
    _merged([c.schema for c in before] + [rows.schema])
    if any(c.unit != tuple(unit) for c in before):
        raise ValueError(f"this lake is replaced by {before[0].unit}, not by {tuple(unit)}")
    commit = uuid.uuid4().hex
    if not _store(rows, path, at, unit, commit).isEmpty():
        _publish(spark, path, commit, unit, at, rows.schema)


def _merged(schemas: Iterable[StructType]) -> StructType:
    """All columns of several schemas, those of the first first, and all of them nullable."""
    fields: dict[str, StructField] = {}
    for f in (f for s in schemas for f in s):
        if fields.setdefault(f.name, f).dataType != f.dataType:
            raise ValueError(f"{f.name} is {fields[f.name].dataType.simpleString()} in this lake, not {f.dataType.simpleString()}")
    return StructType([StructField(f.name, f.dataType, True) for f in fields.values()])


class View:
    """What the commits up to some moment hold. Later commits and compactions do not change it, until vacuum."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.commits = spark, path, log(spark, path)
        if not self.commits:
            raise FileNotFoundError(f"no commit at {path}")
        self.unit, self.schema = self.commits[0].unit, _merged(c.schema for c in self.commits)
        self.dropped = {d for c in self.commits for d in c.drops}

    def _read(self, kind: str, fields: list[StructField]) -> DataFrame:
        """data or cover of all commits but the dropped months, which are pruned as folders."""
        known = [StructField("commit", StringType()), StructField("dataset", StringType()), StructField("year", IntegerType()), StructField("month", IntegerType())]
        schema = StructType([*[f for f in fields if f.name not in PARTITIONS], *known])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/commit={c.id}" for c in self.commits])
        return rows if not self.dropped else rows.filter(~_folder().isin([_named(*d) for d in self.dropped]))

    def cover(self) -> DataFrame:
        """(commit, order, dataset, year, month, unit.., day, rows) of each commit's keys."""
        fields = [*[self.schema[u] for u in self.unit], *StructType.fromDDL(f"{DAY_OF} date, {ROWS} bigint")]
        orders = F.create_map(*[F.lit(x) for c in self.commits for x in (c.id, c.order)])
        return self._read("cover", fields).withColumn("order", orders[F.col("commit")])

    def day(self) -> Column:
        """The day of a row, by the stamp that its commit was written by."""
        of = {at: [c.id for c in self.commits if c.at == at] for at in {c.at for c in self.commits}}
        return F.coalesce(*[F.when(F.col("commit").isin(ids), F.to_date(at)) for at, ids in of.items()])

    def rows(self, where: Column | None = None) -> DataFrame:
        """Rows of the keys' last commits. where: a condition on PARTITIONS, so that nothing else is listed.

        The months that hold hidden rows are few, or compact's work; only their rows meet the
        hidden keys, and all others are read as they are.
        """
        rows, cover = self._read("data", list(self.schema)), self.cover()
        if where is not None:
            rows, cover = rows.filter(where), cover.filter(where)
        if len(self.commits) > 1:
            keys = [*PARTITIONS, *self.unit, DAY_OF]
            last = F.max("order").over(Window.partitionBy(*keys))
            hidden = cover.withColumn("__last", last).filter(F.col("order") < F.col("__last")).select("commit", *keys)
            folders = [r[0] for r in hidden.select(_folder()).distinct().collect()]
            if folders:
                old = hidden.select(*[F.col(c).alias(f"__old_{c}") for c in hidden.columns])
                touched = rows.filter(_folder().isin(folders))
                meet = _meet([F.col("commit"), *[F.col(c) for c in (*PARTITIONS, *self.unit)], self.day()], [F.col(c) for c in old.columns])
                rows = rows.filter(~_folder().isin(folders)).unionByName(touched.join(old, meet, "left_anti"))
        return rows.drop("commit")


def _folder() -> Column:
    """The name of a row's month of a commit, of partition columns alone."""
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("commit", *PARTITIONS)])


def _named(commit: str, dataset: str | None, year: int | None, month: int | None) -> str:
    return "/".join("" if x is None else str(x) for x in (commit, dataset, year, month))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows that count, with dataset, year and month."""
    return View(spark, path).rows()


def holdings(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, unit.., day, rows) of the keys that count, from the covers alone."""
    view = View(spark, path)
    keys = ["dataset", *view.unit, DAY_OF]
    return view.cover().groupBy(*keys).agg(F.max_by(ROWS, "order").alias("rows")).withColumnRenamed(DAY_OF, "day")


def compact(spark: SparkSession, path: str, least: int = 2) -> int:
    """Writes each month of a dataset that at least so many commits hold as one; gives how many months. Writers may go on meanwhile."""
    view, done = View(spark, path), 0
    own = F.concat_ws("/", F.lit(""), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PARTITIONS])
    for at in sorted({c.at for c in view.commits}):
        ids = [c.id for c in view.commits if c.at == at]
        held = view.cover().filter(F.col("commit").isin(ids)).select("commit", *PARTITIONS).distinct()
        months = held.groupBy(*PARTITIONS).agg(F.collect_list("commit").alias("commits")).filter(F.size("commits") >= least).collect()
        if not months:
            continue
        chosen = own.isin([_named("", *[r[c] for c in PARTITIONS]) for r in months]) & F.col("commit").isin(ids)
        commit, rows = uuid.uuid4().hex, view.rows(chosen).drop("year", "month")
        _store(rows, path, at, view.unit, commit)
        drops = [(c, *[r[k] for k in PARTITIONS]) for r in months for c in r.commits]
        _publish(spark, path, commit, view.unit, at, view.schema, order=max(c.order for c in view.commits if c.at == at), drops=drops)
        done += len(months)
    return done


def vacuum(spark: SparkSession, path: str, age: float = 86_400) -> int:
    """Deletes dropped months, and commits without log entry that are older than age seconds; gives how many folders. Views from before a compaction end here."""
    fs, _ = _fs(spark, path)
    commits = log(spark, path)
    known, gone = {c.id for c in commits}, 0
    default = "__HIVE_DEFAULT_PARTITION__"
    for c, *month in {d for c in commits for d in c.drops}:
        name = "/".join(f"{k}={default if v is None else v}" for k, v in zip(PARTITIONS, month))
        gone += fs.delete(_fs(spark, f"{path}/data/commit={c}/{name}")[1], True)
    for kind in ("data", "cover"):
        folder = _fs(spark, f"{path}/{kind}")[1]
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            if s.getPath().getName().removeprefix("commit=") not in known and s.getModificationTime() / 1000 < time.time() - age:
                gone += fs.delete(s.getPath(), True)
    return gone


def scan(spark: SparkSession, path: str, dataset: str, start: str, end: str, symbols: Sequence[str] | None = None,
         at: str = "t") -> DataFrame:
    """Rows of one dataset with stamps in [start, end): partitions, then row groups, then rows are pruned."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    month = F.col("year") * 12 + F.col("month")
    rows = View(spark, path).rows((F.col("dataset") == dataset) & month.between(F.year(lo) * 12 + F.month(lo), F.year(hi) * 12 + F.month(hi)))
    rows = rows.filter((F.col(at) >= lo) & (F.col(at) < hi))
    if symbols is not None:
        rows = rows.filter(F.col("symbol").isin(*symbols))
    return rows.drop(*PARTITIONS)


def klines(spark, path, start, end, interval="1d", **kw) -> DataFrame:
    return scan(spark, path, f"klines_{interval}", start, end, at="open_time", **kw)


def funding(spark, path, start, end, **kw) -> DataFrame:
    return scan(spark, path, "funding", start, end, **kw).select("symbol", "t", "funding_rate", "interval_hours")


def metrics(spark, path, start, end, **kw) -> DataFrame:
    return scan(spark, path, "metrics", start, end, **kw)


def daily_bars(rows: DataFrame) -> DataFrame:
    """Daily klines keyed by the day each bar covers."""
    return rows.select("symbol", F.to_date("open_time").alias("at"), "high", "low", "close", "volume")


def open_interest(rows: DataFrame, symbols: Sequence[str], order: Column | str = "seq") -> DataFrame:
    """Open interest value per sample, the named symbols as columns, the last print of a sample counting."""
    last = rows.groupBy("t", "symbol").agg(F.max_by("open_interest_value", order).alias("v"))
    return last.groupBy("t").pivot("symbol", list(symbols)).agg(F.first("v"))
