"""The warehouse: an hour-partitioned Parquet table, its maintenance and its tables in SQL."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions.scalars import event_time
from streamloom.sources.files import AT_ONCE, Files, append_numbered, name_of, pending, place, place_column, read_table, recover, swap
from streamloom.sources.schemas import EVENT_ROW, PARTITIONS

CODECS = ("snappy", "gzip", "zstd", "none")
#: Files that a compaction swaps at once, and so the rows of the table that says which pack a file is of.
FILES_AT_ONCE = 50_000
#: Fixed value, the table's layout: path of one partition; month, day and hour have two digits.
PARTITION = re.compile(r"app_id=([^/]+)/year=(\d{4})/month=(\d{2})/day=(\d{2})/hour=(\d{2})(?=/|$)")


def codec(name: str | None) -> str:
    """A known codec, else snappy."""
    lower = (name or "").lower()
    return lower if lower in CODECS else "snappy"


def padded(rows: DataFrame) -> DataFrame:
    """Partition columns as they stand in paths."""
    return rows.withColumns({c: F.lpad(F.col(c).cast("string"), 2, "0") for c in ("month", "day", "hour")})


def append(rows: DataFrame, path: str, compression: str | None = "snappy", files_per_partition: int = 1, max_records: int = 0) -> None:
    """Append flat rows. An hour of an app is one shuffle key, a hot one may be spread over several files."""
    spread = F.pmod(F.xxhash64("id"), F.lit(files_per_partition))
    writer = padded(rows).repartition(*PARTITIONS, spread).write.mode("append").partitionBy(*PARTITIONS).option("compression", codec(compression))
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, each once even where a batch or a compaction broke off."""
    return read_table(spark, path, EVENT_ROW, len(PARTITIONS))


def append_batch(rows: DataFrame, path: str, number: int, compression: str | None = "snappy", sink: str = "one") -> bool:
    """Append a sink's numbered batch once, however often it is tried. Sinks are told apart by their names."""
    return append_numbered(padded(rows).repartition(*PARTITIONS), path, number, sink, PARTITIONS, codec(compression))


def create_table(spark: SparkSession, name: str, path: str) -> None:
    """External table over the folder; sync() makes new partitions visible."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_ROW.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({', '.join(PARTITIONS)}) LOCATION '{path}'")
    sync(spark, name)


def sync(spark: SparkSession, name: str) -> None:
    spark.sql(f"MSCK REPAIR TABLE {name}")


def partitions_of(spark: SparkSession, name: str, app_id: str) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS {name} PARTITION (app_id = '{app_id}')")


def time_range(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Events with start <= time < end (UTC), with the partition predicates that a condition on the time alone does not give."""
    hour = F.col("year") * 1_000_000 + F.col("month") * 10_000 + F.col("day") * 100 + F.col("hour")
    number = lambda t: t.year * 1_000_000 + t.month * 10_000 + t.day * 100 + t.hour
    ms = lambda t: int(t.replace(tzinfo=UTC).timestamp() * 1000)
    years = F.col("year").between(start.year, end.year)
    return events.where(years & hour.between(number(start), number(end)) & (F.col("timestamp_ms") >= ms(start)) & (F.col("timestamp_ms") < ms(end)))


def cold(now: datetime) -> Column:
    """Whether a partition's hour ended before the current one began."""
    hour = F.make_timestamp("year", "month", "day", "hour", F.lit(0), F.lit(0))
    return hour < F.lit(now.replace(minute=0, second=0, microsecond=0, tzinfo=UTC))


def cold_path(path: str, now: datetime) -> bool:
    m = PARTITION.search(path)
    if not m:
        return False
    try:
        at = datetime(*map(int, m.groups()[1:]))
    except ValueError:
        return False
    return at < now.replace(minute=0, second=0, microsecond=0, tzinfo=None)


def pack_files(files: DataFrame, target: int, least: int = 2) -> DataFrame:
    """(partition, pack, paths) over files (partition, path, size): small files, in order of path, in packs of at most target bytes and at least so many files."""
    small = files.where((F.col("size") < target) & F.col("path").endswith(".parquet"))
    listed = small.groupBy("partition").agg(F.array_sort(F.collect_list(F.struct("path", "size"))).alias("_files"))
    start = F.expr("named_struct('pack', 0L, 'sum', 0L, 'out', cast(array() as array<struct<pack:bigint,path:string>>))")

    def step(s: Column, x: Column) -> Column:
        over = (s["sum"] + x["size"] > target) & (s["sum"] > 0)
        pack, total = F.when(over, s["pack"] + 1).otherwise(s["pack"]), F.when(over, x["size"]).otherwise(s["sum"] + x["size"])
        return F.struct(pack.alias("pack"), total.alias("sum"), F.array_append(s["out"], F.struct(pack.alias("pack"), x["path"].alias("path"))).alias("out"))

    packed = listed.select("partition", F.explode(F.aggregate("_files", start, step)["out"]).alias("_f"))
    return packed.groupBy("partition", F.col("_f.pack").alias("pack")).agg(F.array_sort(F.collect_list("_f.path")).alias("paths")).where(F.size("paths") >= least)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(partition, path, size) of the table's data files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    listed = files.select(F.regexp_extract("path", PARTITION.pattern.replace("(?=/|$)", ""), 0).alias("partition"), "path", F.col("length").alias("size"))
    return listed.where("partition <> ''").where(~F.col("path").rlike("/_(staged|compacted|swaps|pending|sinks)/"))


def partitions_in(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, year, month, day, hour) of the partitions that have files, by their paths alone."""
    found = list_files(spark, path).select("partition").distinct()
    app = F.url_decode(F.replace(F.regexp_extract("partition", "app_id=([^/]+)/", 1), F.lit("+"), F.lit("%2B")))
    return found.select(app.alias("app_id"), *[c.alias(n) for n, c in _hour_of(F.col("partition")).items()])


def _hour_of(partition: Column) -> dict[str, Column]:
    return {c: F.regexp_extract(partition, f"{c}=([0-9]+)", 1).cast("int") for c in ("year", "month", "day", "hour")}


def _unreadable(spark: SparkSession, paths: list[str]) -> set[str]:
    """Which of the files can't be read: halves are tried side by side, and halves of those that fail. Only after a pack has failed."""

    def fails(some: list[str]) -> bool:
        try:
            spark.read.schema(EVENT_ROW).parquet(*some).write.format("noop").mode("overwrite").save()
            return False
        except Exception:  # whatever is wrong with it, it must stay where it is
            return True

    out: set[str] = set()
    parts = [paths]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        while parts:
            failed = [x for x, bad in zip(parts, pool.map(fails, parts)) if bad]
            out |= {x[0] for x in failed if len(x) == 1}
            parts = [half for x in failed if len(x) > 1 for half in (x[: len(x) // 2], x[len(x) // 2 :])]
    return out


def _rewrite(spark: SparkSession, path: str, packs: list[tuple[str, int, list[str]]], made: str, compression: str) -> None:
    """One job for all packs: a file each below made, with as many rows as theirs have. The files are counted: at most FILES_AT_ONCE and a pack."""
    of = spark.createDataFrame([(place(p, len(PARTITIONS)), n) for n, (_, _, paths) in enumerate(packs) for p in paths], "_file string, _pack int")
    rows = spark.read.option("basePath", path).schema(EVENT_ROW).parquet(*[p for _, _, paths in packs for p in paths])
    dealt = padded(rows.select("*", place_column(len(PARTITIONS)).alias("_file"))).join(F.broadcast(of), "_file").drop("_file")
    dealt.repartition(*PARTITIONS, "_pack").write.mode("overwrite").partitionBy(*PARTITIONS, "_pack").option("compression", compression).parquet(made)
    if (n := spark.read.parquet(made).count()) != (m := rows.count()):
        raise RuntimeError(f"{n} rows written of {m}")


def _codec_of(paths: list[str]) -> str:
    """The codec that most of the files name; Spark's writers put it before the ending."""
    names = {"gz": "gzip", "snappy": "snappy", "zstd": "zstd"}
    found = Counter(names.get(p.removesuffix(".parquet").rpartition(".")[2], "none") for p in paths)
    return found.most_common(1)[0][0]


def _by_codec(packs: list[tuple[str, int, list[str]]]) -> dict[str, list[tuple[str, int, list[str]]]]:
    out: dict[str, list] = {}
    for pack in packs:
        out.setdefault(_codec_of(pack[2]), []).append(pack)
    return out


def _compact_packs(spark: SparkSession, files: Files, path: str, packs: list[tuple[str, int, list[str]]], least: int, compression: str) -> int:
    made = f"{path}/_compacted/{uuid.uuid4().hex}"
    try:
        _rewrite(spark, path, packs, made, compression)
    except Exception:  # one bad file must not keep the others from being compacted
        bad = _unreadable(spark, [p for _, _, paths in packs for p in paths])
        if not bad:
            raise
        packs = [(a, b, kept) for a, b, paths in packs if len(kept := [p for p in paths if p not in bad]) >= least]
        if packs:
            _rewrite(spark, path, packs, made, compression)
    new = {p: f"{path}/{PARTITION.search(p).group(0)}/compacted-{name_of(p)}" for p in files.below(made) if p.endswith(".parquet")}
    swap(files, path, new, [p for _, _, paths in packs for p in paths])
    files.delete(made)
    return len(packs)


def compact(spark: SparkSession, path: str, now: datetime, target: int = 128 << 20, least: int = 2, files_at_once: int = FILES_AT_ONCE) -> int:
    """Rewrite the packs of small files in cold partitions, in the codec that they have; returns how many packs were.

    Packs are written to a folder beside the table, many in one job, and swapped in. A file that can't be read stays, the
    others of its pack are rewritten without it. Files of a batch that is not all in are not touched. The names of small
    files of cold partitions come to the driver a Spark partition at a time, files_at_once of them are swapped at once.
    """
    recover(spark, path)
    files = Files(spark, path)
    listed = list_files(spark, path).withColumns(_hour_of(F.col("partition"))).where(cold(now))
    for start in pending(files, path):
        listed = listed.where(~F.element_at(F.split("path", "/"), -1).startswith(start))
    count, held = 0, []

    def done() -> int:
        return sum(_compact_packs(spark, files, path, packs, least, name) for name, packs in _by_codec(held).items())

    # written first: what is listed must not change under the iteration
    for r in pack_files(listed, target, least).cache().toLocalIterator():
        held.append((r["partition"], r["pack"], list(r["paths"])))
        if sum(len(p) for _, _, p in held) >= files_at_once:
            count, held = count + done(), []
    return count + done()


def drop_before(spark: SparkSession, path: str, now: datetime, hours: int) -> list[str]:
    """Delete whole hours older than so many hours; returns the partitions that are gone."""
    recover(spark, path)
    old = list_files(spark, path).select("partition").distinct().withColumns(_hour_of(F.col("partition"))).where(cold(now - timedelta(hours=hours)))
    gone, files = [r["partition"] for r in old.collect()], Files(spark, path)
    files.each(files.delete, [f"{path}/{p}" for p in gone])
    return sorted(gone)


def keep_since(spark: SparkSession, path: str, start: datetime) -> tuple[int, int]:
    """Delete what is earlier than start (UTC), to the millisecond; returns how many hours went whole and how many files were cut.

    Hours before start's own go as folders. In start's hour, files with an earlier row are written again without those rows
    and swapped; files without any stay as they are.
    """
    whole = len(drop_before(spark, path, start, 0))
    ms = int(start.replace(tzinfo=UTC).timestamp() * 1000)
    rows, files = read(spark, path), Files(spark, path)
    hour = rows.where((F.col("year") == start.year) & (F.col("month") == start.month) & (F.col("day") == start.day) & (F.col("hour") == start.hour))
    early = F.col("timestamp_ms") < ms
    cut = hour.where(early).select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("p")).distinct()
    old = [r["p"] for r in cut.collect()]
    for at in range(0, len(old), FILES_AT_ONCE):
        some, made = old[at : at + FILES_AT_ONCE], f"{path}/_compacted/{uuid.uuid4().hex}"
        kept = spark.read.option("basePath", path).schema(EVENT_ROW).parquet(*some).where(~F.coalesce(early, F.lit(False)))
        padded(kept).write.mode("overwrite").partitionBy(*PARTITIONS).option("compression", _codec_of(some)).parquet(made)
        new = {p: f"{path}/{PARTITION.search(p).group(0)}/cut-{name_of(p)}" for p in files.below(made) if p.endswith(".parquet")}
        swap(files, path, new, some)
        files.delete(made)
    return whole, len(old)


def with_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", event_time(F.col("timestamp_ms")))
