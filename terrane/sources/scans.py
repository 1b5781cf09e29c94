"""Scans that report on themselves: counters of the job that writes, row groups, import log, archive members."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from terrane.functions.fixed import BOX_PAD
from terrane.sources.places import Box

#: Counted rows by outcome that are kept.
KEPT = "kept"


def counted(rows: DataFrame, outcome: Column, reasons: tuple[str, ...], measures: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """The kept rows, and counters that come out of the very job that first computes them.

    ``outcome`` names why a row is dropped, or ``kept``; counters are ``read``, ``kept``, each reason, and the
    number of kept rows for which each of ``measures`` holds. Counting is part of the scan's own
    stage, so nothing is read twice; the observation has its values once an action on the rows has ended.
    """
    seen = Observation(f"scan-{uuid.uuid4()}")
    name = "__outcome"
    test = F.col(name) == KEPT
    counts = [F.count(F.lit(1)).alias("read"), F.count_if(test).alias("kept"), *[F.count_if(F.col(name) == r).alias(r) for r in reasons]]
    counts += [F.count_if(test & F.coalesce(c, F.lit(False))).alias(k) for k, c in (measures or {}).items()]
    return rows.withColumn(name, outcome).observe(seen, *counts).where(test).drop(name), seen


LOG = "import_id string, seq long, source string, country_code string, release string, status string, at timestamp, stats string"


@dataclass
class ImportLog:
    """A log of imports: a row is appended at each change, the newest of an import is its state."""

    path: str

    def append(self, spark, import_id: str, seq: int, source: str, country: str, release: str, status: str, stats: dict) -> None:
        row = spark.createDataFrame([(import_id, seq, source, country, release, status, json.dumps(stats, sort_keys=True))], "import_id string, seq long, source string, country_code string, release string, status string, stats string")
        row.withColumn("at", F.current_timestamp()).select("import_id", "seq", "source", "country_code", "release", "status", "at", "stats").coalesce(1).write.mode("append").parquet(self.path)

    def run(self, spark, source: str, country: str, release: str, work: Callable[[], dict]) -> dict:
        """``work`` between a RUNNING row and a DONE row with its counters, or a FAILED row with the error, which is raised again."""
        import_id = str(uuid.uuid4())
        self.append(spark, import_id, 0, source, country, release, "RUNNING", {})
        try:
            stats = work()
        except Exception as error:
            self.append(spark, import_id, 1, source, country, release, "FAILED", {"error": str(error).split("\n")[0][:500]})
            raise
        self.append(spark, import_id, 1, source, country, release, "DONE", stats)
        return stats

    def states(self, spark) -> DataFrame:
        """The newest row of each import with the time it began."""
        return log_states(spark.read.schema(LOG).parquet(self.path))


def log_states(log: DataFrame) -> DataFrame:
    last = log.groupBy("import_id").agg(F.max(F.struct("seq", "source", "country_code", "release", "status", "at", "stats")).alias("x"), F.min("at").alias("started_at"))
    return last.select("import_id", "x.source", "x.country_code", "x.release", "x.status", "started_at", F.when(F.col("x.status") != "RUNNING", F.col("x.at")).alias("finished_at"), "x.stats")


def import_scan(rows: DataFrame, outcome: Column, reasons: tuple[str, ...], write: Callable[[DataFrame], None], measures: dict[str, Column] | None = None) -> dict[str, int]:
    """Writes the kept rows with ``write`` and returns the counters of that job."""
    kept, seen = counted(rows, outcome, reasons, measures)
    write(kept)
    return dict(seen.get)


def row_groups(files: DataFrame, *columns: str) -> DataFrame:
    """``(file, row_group, n_rows, <column>_min, <column>_max, …)`` of the files that ``files`` reads.

    Bounds are text for strings and double for numbers, dots in names become underscores, and a bound
    is null where a file has no statistics. Only footers are read, one a file, by the driver: a
    release has some hundred files, as Spark's own planning has to list them too.
    """
    spark = files.sparkSession
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    types = {c: _leaf_type(files.schema, c) for c in columns}
    out = []
    for name in sorted(files.inputFiles()):
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            for k, block in enumerate(reader.getFooter().getBlocks()):
                bounds = {}
                for chunk in block.getColumns():
                    path = chunk.getPath().toDotString()
                    if path in types:
                        stats = chunk.getStatistics()
                        known = stats is not None and not stats.isEmpty() and stats.hasNonNullValue()
                        bounds[path] = (_bound(stats.genericGetMin(), types[path]), _bound(stats.genericGetMax(), types[path])) if known else (None, None)
                out.append((name, k, block.getRowCount(), *[x for c in columns for x in bounds.get(c, (None, None))]))
        finally:
            reader.close()
    shape = ", ".join(f"`{c.replace('.', '_')}_{end}` {types[c]}" for c in columns for end in ("min", "max"))
    return spark.createDataFrame(out, f"file string, row_group int, n_rows long, {shape}")


def _leaf_type(schema, path: str) -> str:
    kind = schema
    for name in path.split("."):
        kind = kind[name].dataType
    return "string" if kind.typeName() == "string" else "double"


def _bound(value, kind: str):
    return value.toStringUsingUTF8() if kind == "string" else float(value)


def may_touch(box: Box, prefix: str = "bbox_") -> Column:
    """False only where statistics prove that a row group lies outside the box."""
    b = lambda name: F.col(f"{prefix}{name}")
    outside = (b("xmax_max") < box.west - BOX_PAD) | (b("xmin_min") > box.east + BOX_PAD) | (b("ymax_max") < box.south - BOX_PAD) | (b("ymin_min") > box.north + BOX_PAD)
    known = b("xmin_min").isNotNull() & b("xmax_max").isNotNull() & b("ymin_min").isNotNull() & b("ymax_max").isNotNull()
    return ~F.coalesce(known & outside, F.lit(False))


def may_hold(column: str, value: str) -> Column:
    """False only where statistics prove that a row group does not have the value."""
    return ~F.coalesce((F.col(f"{column}_min") > value) | (F.col(f"{column}_max") < value), F.lit(False))


def group_report(groups: DataFrame, test: Column) -> DataFrame:
    """Files, row groups read and skipped, and rows in those read."""
    return groups.agg(
        F.count_distinct("file").alias("files"), F.count_if(test).alias("groups_read"), F.count_if(~test).alias("groups_skipped"),
        F.coalesce(F.sum(F.when(test, F.col("n_rows"))), F.lit(0)).alias("rows_in_groups_read"),
    )


def member_lines(archives: DataFrame, member: str | None = None, charset: str = "utf-8") -> DataFrame:
    """``(path, member, line_no, value)``: lines of one member (all, if not named) of each zip archive.

    ``archives``: ``(path, content)`` as the ``binaryFile`` source gives it; one task unpacks an
    archive as a stream, so only its packed bytes are held. A file that is no archive and an archive without the
    member are errors with the path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_buffer()))
                except zipfile.BadZipFile as error:
                    raise ValueError(f"{path} is no zip archive") from error
                names = [x for x in archive.namelist() if not x.endswith("/")] if member is None else [member]
                if member is not None and member not in archive.namelist():
                    raise ValueError(f"{path} has no member {member}")
                for name in names:
                    with io.TextIOWrapper(archive.open(name), charset, newline="\n") as lines:
                        found, first = [], 0
                        for line in lines:
                            found.append(line.rstrip("\r\n"))
                            if len(found) == 10_000:
                                yield _lines_batch(path, name, first, found)
                                first, found = first + len(found), []
                        if found:
                            yield _lines_batch(path, name, first, found)

    return archives.select("path", "content").mapInArrow(run, "path string, member string, line_no long, value string")


def _lines_batch(path: str, name: str, first: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.record_batch([pa.array([path] * n), pa.array([name] * n), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())], names=["path", "member", "line_no", "value"])


def last_import(states: DataFrame) -> DataFrame:
    """The newest finished import of each source and country."""
    rank = F.row_number().over(Window.partitionBy("source", "country_code").orderBy(F.desc("finished_at"), F.desc("import_id")))
    return states.where("status = 'DONE'").withColumn("__r", rank).where("__r = 1").drop("__r")
