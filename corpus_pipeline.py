"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return rows
with the columns of ``documents``. Empty tables pass through every stage.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from terrane.llm import decontaminate, lines, packing, quality, simhash
from terrane.session import shared_folder, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null texts are empty and go; rows are judged one by one, repeats and ties included."""
    return quality.keep_good(docs)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which nothing is left go.

    A line stays in the smallest id that has it; rows with one id are one document, rows without an id and
    null texts stay as they are. ``n_chars``, where the table has it, counts the text that is left.
    """
    return lines.without_recurring(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null texts hold none, rows without an id are judged by their text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences; a null text is an empty one, repeated rows are packed each."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", keep_good_quality),
    ("line dedup", drop_recurring_lines),
    ("near duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", pack_sequences),
]

#: The near-duplicate, decontamination and packing stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, work_dir: str | None = None) -> DataFrame:
    """All stages over ``documents``; each is written below the shared folder and read again by the next.

    A run that failed goes on after its last complete stage if it is given the same ``work_dir``; without
    one each run has a folder of its own, which an error names. Each complete stage is marked with what it was
    made from (files and rows of the tables, names of the stages): a ``work_dir`` of other inputs is an error.
    A stage's rows are overwritten by an empty table once the next stage's are written; the last ones stay, for the result reads them.
    """
    base = work_dir or f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    inputs = _inputs(docs, table(spark, sf_dir, "benchmark")) if work_dir else "-"
    marks = {k: mark for k in range(len(STAGES)) if work_dir and (mark := _mark(spark, f"{base}/{k}-done")) is not None}
    if any(mark != inputs for mark in marks.values()):
        raise ValueError(f"{base} holds stages of other inputs")
    done = max(marks, default=-1)
    if done >= 0:
        docs = spark.read.parquet(f"{base}/{done}")
    for k, (name, stage) in enumerate(STAGES):
        if k <= done:
            continue
        try:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{k}")
            spark.createDataFrame([(inputs,)], "inputs string").coalesce(1).write.mode("overwrite").parquet(f"{base}/{k}-done")
        except Exception as error:
            error.add_note(f"stage {name!r} failed; run(..., work_dir={base!r}) goes on from it")
            raise
        before, docs = docs, spark.read.parquet(f"{base}/{k}")
        if k:
            spark.createDataFrame([], before.schema).write.mode("overwrite").parquet(f"{base}/{k - 1}")
    return docs


def _inputs(*tables: DataFrame) -> str:
    """A checksum of the files and row counts of the tables and the names of the stages."""
    parts = [name for name, _ in STAGES]
    for rows in tables:
        parts += [str(rows.count()), *sorted(rows.inputFiles())]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _mark(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.schema("inputs string").parquet(path).first()
    except AnalysisException:
        return None
    return row and row["inputs"]
