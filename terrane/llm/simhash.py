"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of their bit counts is its
embedding. The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, so pairs within ``max_bits`` = 3 are near in the embedding: of the two halves (16
coordinates each) one differs by at most one. Half vectors are the cells of a grid; every
fingerprint is at home in its two cells and visits the cells one step up, so an equi-join on
the cell finds every pair, and only pairs that pass the Manhattan bound are verified exactly.

Coordinates are written in unary (0 -> 00, 1 -> 01, 2 -> 11), so a Manhattan distance is the
bit count of an exclusive or, and the cell of a half is a 32-bit integer.

Copies share a fingerprint and are represented by one of them. A cell with more than
``BLOCK`` rows is split by the exact bits of its half, which no pair within reach crosses; what is
still larger is dealt out as pairs of blocks. Each group returns a spanning forest of its
links instead of all pairs, so a large group of near copies neither meets in one task nor
grows with its square in rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.expressions import fresh, named
from terrane.operators.components import connected_components
from terrane.session import checkpointed

SHINGLE = 3
SEED = 42
#: Rows of a cell that one task compares at once; a pair of blocks holds twice as many.
BLOCK = 2048
LOW = 0x5555555555555555


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text.

    A-Z are lower-cased, words are runs without white space, shingles are three words joined by
    a space, repeats included; a text of fewer words is one shingle, without words it gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1, out=starts[1:])
        first, last = starts[: n - SHINGLE + 1].tolist(), (starts[SHINGLE:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)]
    counts, values = np.zeros(64, dtype=np.int64), np.array(hashes, dtype="<u8")
    for at in range(0, len(values), 65536):
        bits = np.unpackbits(values[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(values)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def unary(fp: Column) -> Column:
    """The embedding: bit counts of the two-bit segments, in unary."""
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(LOW)), 1))


def cells(points: DataFrame) -> DataFrame:
    """``(cell, home, rep, fp)``: two home cells of each fingerprint and the cells one step up from them."""

    def of_half(half: int) -> list[Column]:
        own = F.shiftrightunsigned("u", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        tag = F.lit(half << 32)
        rows = [F.struct(own.bitwiseOR(tag).alias("cell"), F.lit(True).alias("home"))]
        for lane in range(16):
            low, high = F.lit(1 << (2 * lane)), F.lit(2 << (2 * lane))
            step = F.when(own.bitwiseAND(low) == 0, own.bitwiseOR(low)).when(own.bitwiseAND(high) == 0, own.bitwiseOR(high))
            rows.append(F.struct(step.bitwiseOR(tag).alias("cell"), F.lit(False).alias("home")))
        return rows

    placed = points.withColumn("u", unary(F.col("fp"))).select("rep", "fp", F.explode(F.array(*of_half(0), *of_half(1))).alias("c"))
    return placed.where("c.cell IS NOT NULL").select("c.cell", "c.home", "rep", "fp")


def exact_halves() -> Column:
    """The halves, bit by bit, that a row ``(cell, fp)`` of ``cells`` can meet: its own at home, else with one bit more set."""
    half = F.when(F.col("cell").bitwiseAND(F.lit(1 << 32)) == 0, F.lit(0)).otherwise(F.lit(32))
    low32 = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    cut = lambda x: low32(F.when(half == 0, x).otherwise(F.shiftrightunsigned(x, 32)))
    own, step = cut(F.col("fp")), low32(F.col("cell")).bitwiseXOR(cut(unary(F.col("fp"))))
    first = step.bitwiseAND(F.lit(LOW)) != 0  # a lane goes from no bit to one of two, else from one bit to both
    return F.when(step == 0, F.array(own)).when(first, F.array(own.bitwiseOR(step), own.bitwiseOR(F.shiftleft(step, 1)))).otherwise(F.array(own.bitwiseOR(step).bitwiseOR(F.shiftrightunsigned(step, 1))))


def _embed(fp: np.ndarray) -> np.ndarray:
    low, high = np.uint64(LOW), fp >> np.uint64(1)
    return ((fp | high) & low) | (((fp & high) & low) << np.uint64(1))


def _forest(rep: np.ndarray, fp: np.ndarray, home: np.ndarray, side: np.ndarray | None, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a large group that connect all that its links connect: breadth-first, visited rows drop out."""
    emb, rest, links = _embed(fp), np.arange(len(fp)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(emb[rest] ^ emb[at]) <= max_bits
            near &= np.bitwise_count(fp[rest] ^ fp[at]) <= max_bits
            if not home[at]:
                near &= home[rest]
            if side is not None:
                near &= side[rest] != side[at]
            found = rest[near]
            if len(found):
                links.append((np.full(len(found), rep[at]), rep[found]))
                queue.extend(found.tolist())
                rest = rest[~near]
    return links


def link_groups(group: np.ndarray, rep: np.ndarray, fp: np.ndarray, home: np.ndarray, side: np.ndarray, cross: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``group``: all of them in small runs, a spanning forest in large ones.

    Two visitors are not compared, nor are rows of the same block in a group of two blocks.
    """
    bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.diff(bounds)
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= 8), sizes)
    index = np.flatnonzero(small)
    if len(index):
        emb = _embed(fp)
        for step in range(1, 8):
            a = index[: max(len(index) - step, 0)]
            b = index[step:]
            same = (b - a == step) & (group[a] == group[b]) & (home[a] | home[b]) & (~cross[a] | (side[a] != side[b]))
            a, b = a[same], b[same]
            near = np.bitwise_count(emb[a] ^ emb[b]) <= max_bits
            a, b = a[near], b[near]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
            left.append(rep[a[near]])
            right.append(rep[b[near]])
    for k in np.flatnonzero(sizes > 8):
        part = slice(bounds[k], bounds[k + 1])
        for x, y in _forest(rep[part], fp[part], home[part], side[part] if cross[bounds[k]] else None, max_bits):
            left.append(x)
            right.append(y)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def links(points: DataFrame, max_bits: int = 3) -> DataFrame:
    """``(u, v)`` links between representatives that connect what fingerprints within ``max_bits`` connect.

    ``points`` has one row ``(rep, fp)`` for each distinct fingerprint.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the half cells find pairs within three bits")
    placed = cells(points).withColumn("sub", F.lit(0).cast("long"))
    # A crowded cell is split by the exact bits of its half: rows at home there within one bit of another are equal to
    # it in that half, and a visitor differs in the one bit by which it came.
    crowded = placed.groupBy("cell").count().where(F.col("count") > BLOCK).select(F.col("cell").alias("crowded"))
    here = placed.cell == crowded.crowded
    finer = placed.join(crowded, here).withColumn("sub", F.explode(exact_halves()))
    kept = placed.join(crowded, here, "left_anti").select("cell", "sub", "home", "rep", "fp", F.lit(1).cast("long").alias("blocks"))
    # What is still crowded (many fingerprints with the same half) is dealt out as pairs of blocks.
    full = finer.groupBy("cell", "sub").count().where(F.col("count") > BLOCK).select(F.col("cell").alias("c"), F.col("sub").alias("s"), F.ceil(F.col("count") / BLOCK).alias("blocks"))
    finer = finer.join(full, (F.col("cell") == F.col("c")) & (F.col("sub") == F.col("s")), "left").select("cell", "sub", "home", "rep", "fp", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = kept.union(finer).select("cell", "sub", "home", "rep", "fp", own.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cell", "home", "rep", "fp", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "sub")
    sorted_rows = dealt.repartition("cell", "sub", "i", "j").sortWithinPartitions("cell", "sub", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
            return [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            cell, home, rep, fp, side, i, j, sub = rows
            key = np.r_[0, np.cumsum((cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (sub[1:] != sub[:-1]))]
            u, v = link_groups(key, rep, fp.view(np.uint64), home.astype(bool), side, i != j, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        kept: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = columns(batch)
            keys = (rows[0], *rows[5:])
            last = np.logical_and.reduce([x == x[-1] for x in keys])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0  # the last run may go on
            if cut:
                kept.append([x[:cut] for x in rows])
                yield out([np.concatenate(x) for x in zip(*kept, strict=True)])
                kept = []
            elif kept and any(kept[-1][k][-1] != rows[k][0] for k in (0, 5, 6, 7)):
                yield out([np.concatenate(x) for x in zip(*kept, strict=True)])
                kept = []
            kept.append([x[cut:] for x in rows])
        if kept:
            yield out([np.concatenate(x) for x in zip(*kept, strict=True)])

    return sorted_rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits; ``component_id`` is the smallest
    document id reachable over links, the document's own included. Null and empty texts have
    fingerprint 0 and link like any other; repeated rows each give a row; other columns do not
    matter; an empty table gives an empty result. A row without an id links nothing; its component
    is that of its fingerprint, or null if no row with an id has that.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    points = checkpointed(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = connected_components(links(points, max_bits))
    classes = points.join(joined, points.rep == joined.node, "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, prints.fp == classes.class_fp, "left").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The components with fingerprints as 16 lower-case hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the smallest of its component.

    Rows without an id stay; of rows with the same id all stay or none.
    """
    (name,) = fresh(docs, "__later")
    found = near_duplicates(docs, id_col, text_col, max_bits)
    later = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(later, named(id_col).cast("long") == F.col(name), "left_anti")
