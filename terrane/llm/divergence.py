r"""Audit of sources by mergeable radix tries of their terms.

Every task counts the terms of its documents in byte tries, one a language, whose leaves hold a
counter of each source. A trie is written as its leaves in byte order (the order of UTF-8), and so
merges with others by ranges of keys: the leaves are dealt by (language, term) ranges, sorted, and one
pass over neighbours adds their counters and drops terms of too few documents. What is kept is one row a
term. A second pass over these streams shares of every source against every other and against
the language, and keeps for each source the terms that it uses more.
"""

from __future__ import annotations

import gc
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.expressions import named, text_of
from terrane.session import checkpointed

#: Documents of a language that must have a term.
LEAST_DOCS = 30
#: Terms reported for each source.
TOP = 50
#: Bytes of a step in the trie.
STRIDE = 6
#: Counters that a task holds; beyond it, its tries are written and begun anew (their leaves merge later).
CELLS = 500_000
#: A counter is this times the documents plus the occurrences, which stay below it in what one trie holds.
DOCUMENT = 1 << 40
#: Bytes of a text that are split at a time.
SLICE = 1 << 20
#: Key ranges for each shuffle partition, documents and leaves from which their bounds are estimated.
RANGES, SAMPLE_DOCS, SAMPLE_LEAVES = 16, 1000, 20_000
#: Groups (language, source) whose totals are sent to all tasks; more are worked off in batches of languages.
GROUPS = 500_000
#: Counts or pair sums of one language that a task holds in one array.
ARRAY = 1 << 21
BILLION = 1_000_000_000
#: Letters A-Z in lower case, a-z and all bytes of other characters stay, every other byte separates.
TERM_BYTES = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
LEAVES = "range int, lang string, term binary, source string, n long, docs long"
SCORES = "lang string, source string, part string, item string, value long"


class Trie:
    """Terms by steps of ``STRIDE`` bytes; the last step, shorter than that, leads to a leaf: source -> occurrences and documents in one number."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.cells = 0

    def add(self, found: Counter, source: str) -> None:
        """The terms of one document."""
        root, new = self.root, 0
        for term, n in found.items():
            node, step = root, term
            while len(step) >= STRIDE:
                below = node.get(step[:STRIDE])
                if below is None:
                    below = node[step[:STRIDE]] = {}
                node, step = below, step[STRIDE:]
            leaf = node.get(step)
            if leaf is None:
                node[step] = {source: DOCUMENT + n}
                new += 1
            elif source in leaf:
                leaf[source] += DOCUMENT + n
            else:
                leaf[source] = DOCUMENT + n
                new += 1
        self.cells += new

    def leaves(self) -> Iterator[tuple[bytes, dict[str, int]]]:
        """Terms in byte order with their counters."""
        stack = [(b"", iter(sorted(self.root.items())))]
        while stack:
            prefix, children = stack[-1]
            for step, below in children:
                if len(step) == STRIDE:
                    stack.append((prefix + step, iter(sorted(below.items()))))
                    break
                yield prefix + step, below
            else:
                stack.pop()


def terms(raw: bytes) -> Counter:
    """Terms of one text and how often it has them."""
    plain = raw.translate(TERM_BYTES)
    if len(plain) <= SLICE:
        return Counter(plain.split())
    found, at = Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def _leaf_rows(bounds: list[tuple[bytes, bytes]]):
    """Leaves of the tries of one task; for every (language, source) also one without term."""

    def batch(lang: str, terms: list, sizes: list, places: list, sources: list, cells: list) -> pa.RecordBatch:
        packed, sizes = np.array(cells, np.int64), np.array(sizes)
        rows = pa.array(np.repeat(np.arange(len(terms)), sizes))
        columns = [pa.array(np.repeat(np.array(places, np.int32), sizes)), pa.array([lang] * len(cells), pa.string()), pa.array(terms, pa.binary()).take(rows), pa.array(sources, pa.string())]
        return pa.record_batch([*columns, pa.array(packed % DOCUMENT), pa.array(packed // DOCUMENT)], names=["range", "lang", "term", "source", "n", "docs"])

    def written(tries: dict[str, Trie], groups: set[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[str]] = {}
        for lang, source in groups:
            own.setdefault(lang, []).append(source)
        for lang, trie in tries.items():
            key, sources = lang.encode(), own[lang]
            at = bisect_right(bounds, (key, b""))
            yield batch(lang, [b""], [len(sources)], [at], sources, [0] * len(sources))
            names, sizes, places, sources, cells = [], [], [], [], []
            for term, leaf in trie.leaves():
                while at < len(bounds) and bounds[at] <= (key, term):
                    at += 1
                names.append(term)
                sizes.append(len(leaf))
                places.append(at)
                sources += leaf
                cells += leaf.values()
                if len(cells) >= 50_000:
                    yield batch(lang, names, sizes, places, sources, cells)
                    names, sizes, places, sources, cells = [], [], [], [], []
            if cells:
                yield batch(lang, names, sizes, places, sources, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # tries are many dictionaries without cycles; looking for some costs more than counting
        try:
            yield from counted(batches)
        finally:
            gc.enable()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}
        groups: set[tuple[str, str]] = set()
        cells = 0
        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                groups.add((lang, source))
                if (trie := tries.get(lang)) is None:
                    trie = tries[lang] = Trie()
                before = trie.cells
                trie.add(terms(raw.as_py()), source)
                cells += trie.cells - before
                if cells + len(groups) >= CELLS:
                    yield from written(tries, groups)
                    tries, groups, cells = {}, set(), 0
        yield from written(tries, groups)

    return run


def _merged(least: int):
    """Neighbouring leaves of one term added up; terms of fewer documents go, the rows without term stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts, docs = None, Counter(), 0
        out: list[tuple] = []

        def end() -> None:
            if key is not None and (docs >= least or not key[1]):
                out.append((*key, list(counts), list(counts.values())))

        def written() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            kinds = (pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "term", "sources", "counts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term, source, n, found = (batch.column(i) for i in range(5))
            fresh = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(fresh) + 1])
            ends = np.concatenate([starts[1:], [batch.num_rows]])
            sums = np.add.reduceat(found.to_numpy(), starts)
            if (first := (lang[0].as_py(), term[0].as_py())) != key:
                end()
                key, counts, docs = first, Counter(), 0
            last = len(starts) - 1
            for i in np.flatnonzero((sums >= least) | (np.arange(len(sums)) == 0) | (np.arange(len(sums)) == last) | (pc.binary_length(term.take(pa.array(starts))).to_numpy() == 0)):
                if i:
                    end()
                    key, counts, docs = (lang[int(starts[i])].as_py(), term[int(starts[i])].as_py()), Counter(), 0
                at = slice(int(starts[i]), int(ends[i]))
                for s, k in zip(source[at].to_pylist(), n[at].to_pylist(), strict=True):
                    counts[s] += k
                docs += int(sums[i])
                if i and i < last:
                    end()
                    key = None
            if len(out) >= 5_000:
                yield written()
        end()
        yield written()

    return run


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """One row (lang, term, sources, counts) for each term that ``least`` documents of its language have.

    The row with the empty term lists all sources of the language, with counts of zero. ``docs`` has
    a language, a source and a text as bytes.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rate = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    sample = docs.sample(rate, 7).mapInArrow(_leaf_rows([]), LEAVES).select("lang", "term")
    keys = sorted((r["lang"].encode(), bytes(r["term"])) for r in sample.orderBy(F.xxhash64("term", "lang"), "lang", "term").limit(SAMPLE_LEAVES).collect())
    ranges = parts * RANGES
    bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    leaves = docs.mapInArrow(_leaf_rows(bounds), LEAVES).repartition(parts, "range").select("lang", "term", "source", "n", "docs")
    # By term first: its leading bytes decide most comparisons, and leaves of one term and language still are neighbours.
    return leaves.sortWithinPartitions("term", "lang").mapInArrow(_merged(least), "lang string, term binary, sources array<string>, counts array<long>")


def per_billion(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * part / whole)`` for 0 <= part <= whole < 2**53, without overflow."""
    if part.max(initial=0) < 1 << 33:
        return 1 + part * BILLION // whole
    q, r = 0, part
    for _ in range(3):
        q, r = q * 1000 + r * 1000 // whole, r * 1000 % whole
    return 1 + q


def _scored(totals: dict[str, tuple[list[str], np.ndarray, int]], top: int):
    """Pair sums and best terms of one task. ``totals``: of a language its sources, their totals, its number of terms."""
    place = {lang: {s: i for i, s in enumerate(sources)} for lang, (sources, _, _) in totals.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

        def rows(lang: list, source: list, part: str, item: list, value) -> pa.RecordBatch:
            return pa.record_batch([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array([part] * len(lang), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

        def pairs(lang: str, first: int, block: np.ndarray) -> pa.RecordBatch:
            sources = totals[lang][0]
            a, b = (x.ravel() for x in np.indices(block.shape))
            keep = a + first != b
            return rows([lang] * int(keep.sum()), [sources[i + first] for i in a[keep]], "pair", [sources[i] for i in b[keep]], block.ravel()[keep])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                if lang not in totals:
                    continue
                sources, group, v = totals[lang]
                at, size = np.flatnonzero(langs == lang), len(sources)
                step = max(1, ARRAY // size)
                for chunk in (at[i : i + step] for i in range(0, len(at), step)):
                    words = [batch.column(1)[int(i)].as_py() for i in chunk]
                    counts = np.zeros((len(chunk), size), np.int64)
                    for row, i in enumerate(chunk):
                        counts[row, [place[lang][s] for s in batch.column(2)[int(i)].as_py()]] = batch.column(3)[int(i)].as_py()
                    live = np.array([bool(w) for w in words])
                    counts, words = counts[live], [w for w in words if w]
                    if not words:
                        continue
                    p = per_billion(counts + 5, group + 5 * v)
                    q = per_billion(counts.sum(axis=1) + 5, group.sum() + 5 * v)
                    if size * size <= ARRAY:
                        block = sums.setdefault(lang, np.zeros((size, size), np.int64))
                        for g in range(size):
                            block[g] += np.abs(p - p[:, g : g + 1]).sum(axis=0)
                    else:
                        stripe = max(1, ARRAY // size)
                        for first in range(0, size, stripe):
                            yield pairs(lang, first, np.array([np.abs(p - p[:, g : g + 1]).sum(axis=0) for g in range(first, min(size, first + stripe))]))
                    more = np.where(counts > 0, p - q[:, None], 0)
                    for g in np.flatnonzero((more > 0).any(axis=0)):
                        own = more[:, g]
                        least = np.partition(own, -top)[-top] if len(own) > top else 1
                        found = best.get((lang, g), []) + [(-int(own[i]), words[i]) for i in np.flatnonzero((own >= least) & (own > 0))]
                        best[lang, g] = sorted(found)[:top]
        for lang, block in sums.items():
            yield pairs(lang, 0, block)
        for (lang, g), found in best.items():
            yield rows([lang] * len(found), [totals[lang][0][g]] * len(found), "term", [w.decode() for _, w in found], [-x for x, _ in found])

    return run


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How far the term shares of the sources of a language lie apart, and the terms that set each source off.

    A term is a run of letters A-Z (in lower case) and characters beyond ASCII. A share is
    ``1 + floor(10**9 * (count + 5) / (N + 5 * V))`` over the V terms kept for the language. Part ``pair`` ranks
    for each source the others by the sum of the differences of their shares over all kept terms, part
    ``term`` its ``top`` terms with a larger share than in the language as a whole; ties by UTF-8 order.

    Nulls count as empty strings; an empty name is a language or source like any other. A source without terms has
    pairs, and one alone in its language has none. A document that occurs again counts again.
    Other columns do not matter; an empty table gives an empty result. ``docs`` is read three times (for
    its number of rows, the sample of key ranges and the count).
    """
    spark = docs.sparkSession
    texts = docs.select(text_of(named(lang_col).cast("string")).alias("lang"), text_of(named(source_col).cast("string")).alias("source"), text_of(named(text_col)).cast("binary").alias("raw"))
    kept = checkpointed(kept_terms(texts, least))
    cells = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    groups = checkpointed(cells.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"), F.count_if(F.length("term") > 0).alias("own")))
    sizes = kept.groupBy("lang").agg(F.count_if(F.length("term") > 0).alias("v"))
    batches = max(1, -(-groups.count() // GROUPS))
    parts = []
    for b in range(batches):
        mine = lambda df: df.where(F.pmod(F.xxhash64("lang"), F.lit(batches)) == b) if batches > 1 else df  # noqa: E731, B023
        by: dict[str, list] = {}
        for r in mine(groups).orderBy("lang", "source").select("lang", "source", "n").collect():
            by.setdefault(r["lang"], []).append((r["source"], r["n"]))
        v = {r["lang"]: r["v"] for r in mine(sizes).collect()}
        totals = {lang: ([s for s, _ in x], np.array([n for _, n in x], np.int64), v[lang]) for lang, x in by.items()}
        parts.append(checkpointed(mine(kept).mapInArrow(_scored(totals, top), SCORES)))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    a, b = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    without = sizes.where("v = 0").select("lang")
    none = a.join(without, "lang").join(b, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pair = scored.where("part = 'pair'").unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    term = scored.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pair.withColumn("rank", rank).unionByName(term)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
c AS (SELECT k, lang, source, term, count(*) AS n
      FROM (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
v AS (SELECT lang, term FROM c GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, sum(n)::BIGINT AS n FROM c JOIN v USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, v.term, coalesce(o.n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN o USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w)::BIGINT AS p FROM x WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n)::BIGINT AS n FROM x GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w)::BIGINT AS q FROM l WINDOW w AS (PARTITION BY lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""
