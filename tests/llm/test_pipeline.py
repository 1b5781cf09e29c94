"""The pipeline against brute force, stage by stage, and on awkward tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as pipeline
from terrane.llm import decontaminate, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed: int, n: int = 80) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('klmnop')}{rng.randrange(400):x}".replace("0", "o").translate(str.maketrans("123456789", "qrstuvwxy")) for _ in range(n))


def corpus(spark, folder):
    passage = text(999, 40)
    rows = {i: text(i) for i in range(20)}
    rows[30] = rows[3]
    rows[31] = rows[4].replace(rows[4].split()[5], "changed", 1)
    rows[32] = text(32) + "\n" + passage
    rows[33] = "junk " * 80
    rows[34] = None
    for i in range(40, 45):
        rows[i] = text(i) + "\nthe same footer line of some words for all documents here"
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows.items()], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows = corpus(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        seen.append({r["doc_id"]: r for r in docs.collect()})
    good, lined, single, clean = seen
    assert set(good) == set(rows) - {33, 34}
    footer = "\nthe same footer line of some words for all documents here"
    assert set(lined) == set(good) - {30}  # a copy of document 3, of which no line is left
    assert lined[40]["text"] == rows[40] and all(lined[i]["text"] == rows[i].removesuffix(footer) and lined[i]["n_chars"] == len(lined[i]["text"]) for i in range(41, 45))
    assert set(single) == set(lined) - {31}
    assert set(clean) == set(single) - {32}
    packed = pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(clean)


def test_stages_are_the_ones_asked_for():
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "packing"]
    assert quality.RULES and decontaminate.MASKS


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_a_work_folder_of_other_inputs(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    corpus(spark, one)
    corpus(spark, two)
    work = str(tmp_path / "work")
    first = sorted(map(str, pipeline.run(spark, one, work).collect()))
    assert sorted(map(str, pipeline.run(spark, one, work).collect())) == first  # nothing is left to do
    with pytest.raises(ValueError, match="other inputs"):
        pipeline.run(spark, two, work)
