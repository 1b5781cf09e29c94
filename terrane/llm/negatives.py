"""Hard-negative mining by distributed radix selection.

Anchors are taken in blocks. For a block every task scores its rows against all anchors of the block by
one matrix product and keeps, for each window (an anchor, a range of scores, same or other label),
a histogram of 256 equal score ranges. The merged histograms say in which range the kth best score lies;
that range is divided again, digit by digit, and where more rows than wanted share one score, so
are the ids. When few enough rows lie at or above a window's bound, one last pass gathers exactly these.

No task holds more than the histograms of one block, a task sends no more ranges of a window than
it needs to reach its own kth row, and the driver sees one row for each window of a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.expressions import named
from terrane.session import checkpointed, shared_folder

#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Components of a larger absolute value: their scores might not fit a long, so the row takes no part.
LARGEST = 1 << 24
#: Anchors of one block, on average; with five windows each, all histograms of a task take 10 MB.
BLOCK_ANCHORS = 1024
#: A score range is divided by 256 at a time.
DIGIT = 8
#: Scores held at a time: rows of a product times anchors.
SCORES = 1 << 22
#: Rows above a window's bound that are gathered without dividing further, as a multiple of those wanted.
SLACK = 8
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
IDS = np.iinfo(np.int64)


@dataclass
class Anchors:
    """The anchors of one block."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


@dataclass
class Search:
    """The state of the windows of one block: of each the ``k`` best rows with low <= score <= high are sought.

    ``floor`` .. ``ceil`` is the score range, and once a single score is left ``id_low`` .. ``id_high``
    the id range, that holds the kth row; ``above`` rows are better than all of it.
    """

    anchor: np.ndarray
    same: bool
    low: np.ndarray
    high: np.ndarray
    k: int
    positive: np.ndarray = field(default=None)
    positive_score: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        n = len(self.anchor)
        self.floor, self.ceil = self.low.copy(), self.high.copy()
        self.id_low, self.id_high = np.full(n, IDS.min), np.full(n, IDS.max)
        self.above, self.by_id, self.done = np.zeros(n, np.int64), np.zeros(n, bool), self.low > self.high

    def shifts(self) -> np.ndarray:
        """Bits below the digit that is looked at."""
        wide = [(int(b) - int(a)) if i else (int(d) - int(c)) for a, b, c, d, i in zip(self.id_low, self.id_high, self.floor, self.ceil, self.by_id, strict=True)]
        return np.array([max(0, x.bit_length() - DIGIT) for x in wide], np.int64)

    def narrow(self, found: list[tuple[int, int, int, int]], shifts: np.ndarray) -> None:
        """``found``: for each window that has a kth row the number of its range, rows before and in it."""
        seen = np.zeros(len(self.anchor), bool)
        for w, bucket, before, count in found:
            seen[w], step = True, 1 << int(shifts[w])
            self.above[w] += before
            if self.by_id[w]:
                first = int(self.id_low[w]) + bucket * step
                self.id_low[w], self.id_high[w] = first, min(int(self.id_high[w]), first + step - 1)
            else:
                last = int(self.ceil[w]) - bucket * step
                self.ceil[w], self.floor[w] = last, max(int(self.floor[w]), last - step + 1)
            if self.above[w] + count <= SLACK * self.k or (self.by_id[w] and self.id_low[w] == self.id_high[w]):
                self.done[w] = True
            elif self.floor[w] == self.ceil[w]:
                self.by_id[w] = True
        self.done |= ~seen  # fewer than k rows: the whole window


def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and whole-number vectors of the rows that take part; shorter vectors are filled up with zeros."""
    for batch in batches:
        ids, labels, lists = (batch.column(i) for i in range(3))
        n = len(ids)
        if not n:
            continue
        sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(), 0)
        flat = lists.flatten()
        x = np.floor(flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        bad = ~(np.abs(x) <= LARGEST)
        rows, wide = np.repeat(np.arange(n), sizes), int(sizes.max())
        ok = np.bincount(rows[bad], minlength=n) == 0
        for column in (ids, labels, lists):
            ok &= column.is_valid().to_numpy(zero_copy_only=False)
        dense = np.zeros((n, wide))
        dense[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(bad, 0, x)
        yield ids.fill_null(0).to_numpy()[ok], labels.fill_null(0).to_numpy()[ok], dense[ok]


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, one line an anchor."""
    wide = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :wide], rows[:, :wide]
    if wide * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def scored(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and scores of so many rows at a time that their scores stay bounded."""
    step = max(1, SCORES // max(1, len(anchors.ids)))
    for ids, labels, rows in usable(batches):
        for at in range(0, len(ids), step):
            yield ids[at : at + step], labels[at : at + step], scores(anchors.vectors, rows[at : at + step])


def _eligible(anchors: Anchors, a: int, same: bool, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return np.flatnonzero((labels == anchors.labels[a]) & (ids != anchors.ids[a]) if same else labels != anchors.labels[a])


def _windows_of(search: Search, live: np.ndarray) -> list[tuple[int, list[int]]]:
    by: dict[int, list[int]] = {}
    for w in live:
        by.setdefault(int(search.anchor[w]), []).append(int(w))
    return list(by.items())


def _histograms(anchors: Anchors, search: Search, shifts: np.ndarray):
    """Rows of one task for each window: range number and count, up to the range of its own kth row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = np.flatnonzero(~search.done)
        place = {int(w): i for i, w in enumerate(live)}
        counts, groups = np.zeros((len(live), 1 << DIGIT), np.int64), _windows_of(search, live)
        for ids, labels, table in scored(batches, anchors):
            for a, windows in groups:
                rows = _eligible(anchors, a, search.same, ids, labels)
                s = table[a][rows]
                for w in windows:
                    if search.by_id[w]:
                        own = ids[rows[s == search.floor[w]]]
                        own = own[(own >= search.id_low[w]) & (own <= search.id_high[w])]
                        digit = (own.astype(np.uint64) - search.id_low[w].astype(np.uint64)) >> np.uint64(shifts[w])
                    else:
                        digit = (search.ceil[w] - s[(s >= search.floor[w]) & (s <= search.ceil[w])]) >> shifts[w]
                    if len(digit):
                        counts[place[w]] += np.bincount(digit.astype(np.int64), minlength=1 << DIGIT)
        before = np.cumsum(counts, axis=1) - counts
        w, bucket = np.nonzero((counts > 0) & (before < (search.k - search.above[live])[:, None]))
        yield pa.record_batch([pa.array(live[w].astype(np.int64)), pa.array(bucket.astype(np.int64)), pa.array(counts[w, bucket])], names=["w", "bucket", "n"])

    return run


def _gathered(anchors: Anchors, search: Search):
    """The rows of one task at or above the bound of each window, no more of a window than it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _windows_of(search, np.flatnonzero(search.low <= search.high))
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for ids, labels, table in scored(batches, anchors):
            for a, windows in groups:
                rows = _eligible(anchors, a, search.same, ids, labels)
                s = table[a][rows]
                for w in windows:
                    at = (s >= search.floor[w]) & (s <= search.high[w])
                    if search.by_id[w]:
                        at &= (s > search.floor[w]) | (ids[rows] <= search.id_high[w])
                    if at.any():
                        i, x = np.concatenate([ids[rows[at]], *([best[w][0]] if w in best else [])]), np.concatenate([s[at], *([best[w][1]] if w in best else [])])
                        order = np.lexsort((i, -x))[: search.k]
                        best[w] = i[order], x[order]
        w = np.repeat(np.fromiter(best, np.int64, len(best)), [len(x[0]) for x in best.values()])
        i, x = (np.concatenate([v[k] for v in best.values()]) if best else np.zeros(0, np.int64) for k in (0, 1))
        yield pa.record_batch([pa.array(w), pa.array(i), pa.array(x)], names=["w", "id", "score"])

    return run


def select(vectors: DataFrame, anchors: Anchors, search: Search) -> DataFrame:
    """The rows (w, rank, id, score) of each window: its ``k`` best by score, ties by smaller id.

    ``vectors`` has an id, a label and a vector, in this order. Each division of ranges is a pass over it.
    """
    while not search.done.all():
        shifts = search.shifts()
        counts = vectors.mapInArrow(_histograms(anchors, search, shifts), "w long, bucket long, n long").groupBy("w", "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("w").orderBy("bucket"))
        need = F.element_at(F.lit([int(x) for x in search.k - search.above]), (F.col("w") + 1).cast("int"))
        kth = counts.withColumn("upto", upto).where((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need))
        search.narrow([(r["w"], r["bucket"], r["upto"] - r["n"], r["n"]) for r in kth.collect()], shifts)
    rows = vectors.mapInArrow(_gathered(anchors, search), "w long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= search.k)


def _block(rows: list, largest: int) -> tuple[Anchors, np.ndarray]:
    wide = max(len(r["q"]) for r in rows)
    vectors = np.array([[*r["q"], *[0] * (wide - len(r["q"]))] for r in rows], np.float64).reshape(len(rows), wide)
    reach = np.abs(vectors).sum(axis=1).astype(np.int64) * largest
    return Anchors(np.array([r["id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), vectors), reach


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """Of each anchor and each of its ``positives`` nearest rows of the same label, the nearest ``negatives``
    rows of another label whose score is between ``low`` and ``high`` per cent of the positive's.

    Scores are inner products of ``floor(256 * x)``, the highest first, ties by the smaller id. Rows
    with a null id, label or vector, with a component that is null, not finite or beyond 65,536
    take no part; a shorter vector counts as filled up with zeros. An anchor's id that occurs
    again is one anchor (its smallest label and vector) and never its own positive; any other row that occurs again
    counts as often as it occurs. Columns other than the three do not matter; without anchors the result is empty.

    Blocks of anchors are worked off one after the other, each written as part of one table in the shared
    folder, so memory does not grow with the number of anchors; ``rows`` is read several times a block.
    """
    spark = rows.sparkSession
    vectors = rows.select(named(id_col).cast("long").alias("id"), named(label_col).cast("long").alias("label"), named(vector_col).cast("array<double>").alias("v"))
    chosen = rows.where(is_anchor).select(named(id_col).cast("long").alias("id"), named(label_col).cast("long").alias("label"), named(vector_col).cast("array<double>").alias("v"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, q in usable(batches):
            yield pa.record_batch([pa.array(ids), pa.array(labels), pa.array([x.astype(np.int64).tolist() for x in q], pa.list_(pa.int64()))], names=["id", "label", "q"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([max([0, *(int(np.abs(q).max(initial=0)) for _, _, q in usable(batches))])])], names=["n"])

    anchors = checkpointed(chosen.mapInArrow(whole, "id long, label long, q array<long>").groupBy("id").agg(F.min(F.struct("label", "q")).alias("x")).select("id", "x.label", "x.q"))
    n = anchors.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    largest = vectors.mapInArrow(reach, "n long").agg(F.max("n")).first()[0]
    blocks, path = -(-n // block_anchors), f"{shared_folder(spark)}/negatives-{uuid.uuid4()}"
    for b in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        if not part:
            continue
        block, far = _block(part, largest)
        every = np.arange(len(part))
        near = select(vectors, block, Search(every, True, -far, far, positives)).collect()
        near.sort(key=lambda r: (r["w"], r["rank"]))
        score = [r["score"] for r in near]
        search = Search(
            np.array([r["w"] for r in near], np.int64), False, np.array([-(-low * s // 100) for s in score], np.int64), np.array([high * s // 100 for s in score], np.int64), negatives,
            np.array([r["id"] for r in near], np.int64), np.array(score, np.int64),
        )
        found = select(vectors, block, search)
        names = spark.createDataFrame([(w, int(block.ids[a]), int(p), int(s)) for w, (a, p, s) in enumerate(zip(search.anchor, search.positive, search.positive_score, strict=True))], "w long, anchor_id long, positive_id long, positive_score long")
        out = found.join(F.broadcast(names), "w").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's mining: anchors are ids divisible by 100, labels of ids divisible by seven move on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id AS id, list_dot_product(a.q, v.q)::BIGINT AS score
      FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
