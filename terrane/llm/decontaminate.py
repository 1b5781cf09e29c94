"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a few neighbouring tokens that ignores some positions, so a
hash of the kept ones survives a substitution at an ignored one. Windows of the benchmark items
and of the documents are joined on these hashes; around each hit the item is laid over the
document without gaps and the best segment is scored, so overlaps with substituted tokens are
verified token by token. Items too short for these seeds get seeds over the whole item.

A benchmark of bounded size is broadcast as a sorted table of hashes and joined where the documents
are read. A larger one stays a table: a bit filter of fixed size over its hashes is broadcast, the
few windows of documents that pass it are joined with it by a shuffle, and each candidate meets its
item for the verification. Either way the documents are not read more often for a larger benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.expressions import fresh, named
from terrane.session import checkpointed

#: Kept (1) and ignored (0) positions; every window of 13 tokens with up to three substitutions is hit by one of them.
MASKS = ("1110011", "101111", "111000011", "110010101")
#: Shortest overlap in tokens (an item of fewer tokens must overlap as a whole).
MIN_TOKENS = 13
#: Share of equal tokens in an overlap.
MIN_IDENTITY = 0.8
#: Characters of a benchmark that is broadcast (an index of some 200 bytes a token).
BROADCAST_CHARS = 2_000_000
#: Binary logarithm of the bits of the filter over the hashes of a larger benchmark (16 MB).
FILTER_BITS = 27
MULTIPLIER = 0x9E3779B97F4A7C15

_LETTERS = bytes(range(256)).lower()
#: A-Z in lower case, ASCII punctuation as space.
TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in _LETTERS)

#: Scripts without spaces: a Han or kana character, or a base letter of South East Asia with its vowel and tone marks.
UNSPACED = re.compile(
    "[\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3031-\u3035\u303b\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]"
    "|[\u0e40-\u0e44]?[\u0e01-\u0e2e][\u0e2f-\u0e3a\u0e45-\u0e4e]*|[\u0ec0-\u0ec4]?[\u0e81-\u0eae\u0edc-\u0edf][\u0eaf-\u0ebd\u0ec6-\u0ece]*"
    "|[\u1780-\u17b3](?:\u17d2[\u1780-\u17b3]|[\u17b4-\u17d1\u17d3\u17d7\u17dd])*|[\u1000-\u102a\u103f](?:\u1039[\u1000-\u102a]|[\u102b-\u103e])*"
)
#: Punctuation of these scripts, as space.
UNSPACED_MARKS = re.compile("[\u3000-\u3003\u3008-\u3020\u3030\u303d\u30a0\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\u104a\u104b\u17d4-\u17d6\u0e5a\u0e5b]+")

OUTPUT = "doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_equal long"


def tokens(text: str | None) -> list[bytes]:
    text = text or ""
    if not text.isascii():
        text = UNSPACED.sub(r" \g<0> ", UNSPACED_MARKS.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def short_masks(n: int) -> tuple[str, ...]:
    """Masks as long as an item of ``n`` tokens, where ``MASKS`` miss some of the substitutions it may have (none below 5 tokens, one up to 7)."""
    if n < 5:
        return ("1" * n,)
    if n < 8:
        cuts = [round(k * n / 3) for k in range(4)]
        return tuple("".join("0" if a <= i < b else "1" for i in range(n)) for a, b in zip(cuts, cuts[1:], strict=False))
    return ()


@dataclass
class Index:
    """Token numbers and seed hashes of a block of benchmark items."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[np.ndarray] = field(default_factory=list)
    ids: list[int | None] = field(default_factory=list)

    def add(self, item_id: int | None, words: list[bytes]) -> None:
        number = self.vocabulary
        self.ids.append(item_id)
        self.items.append(np.array([number.setdefault(w, len(number) + 1) for w in words], dtype=np.int64))

    def seal(self) -> None:
        """Sort the hashes of all windows and mark them in a table of bits for a quick first look."""
        self.masks, self.hashes, self.owners, self.places, self.marks = [], [], [], [], []
        by_length: dict[int, list[int]] = {}
        for k, item in enumerate(self.items):
            by_length.setdefault(len(item), []).append(k)
        plans = [(mask, range(len(self.items))) for mask in MASKS] + [(mask, by_length[n]) for n in sorted(by_length) for mask in short_masks(n)]
        for mask, chosen in plans:
            self.masks.append(mask)
            h, o, p = [], [], []
            for k in chosen:
                item = self.items[k]
                found = seed_hashes(item, mask)
                h.append(found)
                o.append(np.full(len(found), k))
                p.append(np.arange(len(found)))
            h, o, p = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (h, o, p))
            order = np.argsort(h, kind="stable")
            self.hashes.append(h[order].astype(np.uint64))
            self.owners.append(o[order].astype(np.int64))
            self.places.append(p[order].astype(np.int64))
            marks = np.zeros(1 << 20, dtype=bool)
            marks[(self.hashes[-1] >> np.uint64(44)).astype(np.int64)] = True
            self.marks.append(marks)


def seed_hashes(numbers: np.ndarray, mask: str) -> np.ndarray:
    """A 64-bit hash of the kept tokens of each window."""
    n = len(numbers) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    values, out = numbers.astype(np.uint64), np.zeros(n, np.uint64)
    for at, kept in enumerate(mask):
        if kept == "1":
            out += values[at : at + n]
            out *= np.uint64(MULTIPLIER)
            out ^= out >> np.uint64(29)
    return out * np.uint64(MULTIPLIER)


def best_segment(equal: np.ndarray, min_identity: float = MIN_IDENTITY) -> tuple[int, int, int]:
    """Start, length and equal tokens of the longest run whose share of equal tokens is high enough and whose ends are equal."""
    where = np.flatnonzero(equal)
    if not len(where):
        return 0, 0, 0
    # A run from the a-th to the b-th equal token is good if (b - a + 1) >= identity * (where[b] - where[a] + 1).
    score = np.arange(len(where)) - min_identity * where
    need = 1 - min_identity
    best = (0, 0, 0)
    lowest = np.minimum.accumulate(score)
    for b in range(len(where) - 1, -1, -1):
        if where[b] + 1 <= best[1]:
            break
        a = int(np.searchsorted(-lowest[: b + 1], -(score[b] + need + 1e-9)))  # the first start that is good for this end
        if a <= b and (length := int(where[b] - where[a]) + 1) > best[1]:
            best = (int(where[a]), length, b - a + 1)
    return best


def overlaps(words: list[bytes], index: Index, min_tokens: int = MIN_TOKENS, min_identity: float = MIN_IDENTITY) -> list[tuple[int, int, int, int, int]]:
    """``(item_id, doc_start, item_start, n_tokens, n_equal)`` of the verified overlaps of one document, at most one a diagonal."""
    known = index.vocabulary
    numbers = np.array([known.get(w, 0) for w in words], dtype=np.int64)
    seen: set[tuple[int, int]] = set()
    for mask, hashes, owners, places, marks in zip(index.masks, index.hashes, index.owners, index.places, index.marks, strict=True):
        own = seed_hashes(numbers, mask)
        hits = np.flatnonzero(marks[(own >> np.uint64(44)).astype(np.int64)])
        if not len(hits):
            continue
        low, high = np.searchsorted(hashes, own[hits], "left"), np.searchsorted(hashes, own[hits], "right")
        for at, a, b in zip(hits[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            seen.update(zip(owners[a:b].tolist(), (at - places[a:b]).tolist(), strict=True))
    out = []
    for k, shift in sorted(seen):
        first = max(0, shift)
        if hit := verified(index.items[k], numbers[first : shift + len(index.items[k])], first, shift, min_tokens, min_identity):
            out.append((index.ids[k], *hit))
    return out


def verified(item: np.ndarray, window: np.ndarray, first: int, shift: int, min_tokens: int = MIN_TOKENS, min_identity: float = MIN_IDENTITY) -> tuple[int, int, int, int] | None:
    """``(doc_start, item_start, n_tokens, n_equal)`` of an item laid over a document at ``shift``, if that is an overlap.

    ``window`` holds the document's tokens under the item, from token ``first`` on.
    """
    at = first - shift
    equal = item[at : at + len(window)] == window
    start, length, same = best_segment(equal, min_identity)
    if length < len(item) <= min_tokens and len(equal) == len(item) and equal.sum() >= min_identity * len(item) - 1e-9:
        start, length, same = 0, len(item), int(equal.sum())  # the whole item counts, whatever its ends
    return (first + start, at + start, length, same) if length >= min(min_tokens, len(item)) else None


def read_index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Index:
    """The index of a benchmark of bounded size."""
    index = Index()
    for row in benchmark.select(named(id_col).cast("long"), named(text_col)).toLocalIterator():
        if words := tokens(row[1]):
            index.add(row[0], words)
    index.seal()
    return index


def token_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64).view(np.int64)


def all_seeds(numbers: np.ndarray, lengths: frozenset[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and places of all windows by all masks: of an item, or of a document given the lengths of short items."""
    short = sorted(lengths) if lengths is not None else [len(numbers)]
    for number, mask in enumerate((*MASKS, *(m for n in short for m in short_masks(n)))):
        # A mask's length and kept places tell it apart: windows meet those of the same mask only.
        hashes = seed_hashes(numbers, mask) ^ np.uint64(int(mask, 2) * MULTIPLIER % 2**64 if number >= len(MASKS) else number)
        yield hashes, np.arange(len(hashes))


def _columns(rows: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    """A batch of the rows' arrays, the first of them hashes."""
    columns = [np.concatenate(x) for x in zip(*rows, strict=True)] or [np.empty(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64) if k == 0 else x.astype(np.int64)) for k, x in enumerate(columns)], names)


def _joined(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, filter_bits: int) -> DataFrame:
    """``contaminations`` for a benchmark of any size."""
    items = checkpointed(benchmark.select(F.monotonically_increasing_id().alias("item"), named("item_id").cast("long").alias("item_id"), named("text").alias("text")))
    lengths = lambda rows: [(n,) for n in sorted({len(w) for w in rows if 0 < len(w) < 8})]

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(hashes, np.full(len(hashes), item), places) for item, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True) if tokens(text) for hashes, places in all_seeds(token_hashes(tokens(text)))]
            yield _columns(rows, ["hash", "item", "place"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n for (n,) in lengths(map(tokens, batch.column(2).to_pylist()))], pa.int64())], ["n"])

    found = checkpointed(items.mapInArrow(seeds, "hash long, item long, place long"))
    shorts = frozenset(r[0] for r in items.mapInArrow(short, "n long").distinct().collect())  # at most seven lengths
    buckets = found.select(F.shiftrightunsigned("hash", 64 - filter_bits).alias("n"))
    words = buckets.select(F.shiftright("n", 6).alias("w"), F.expr("shiftleft(1L, cast(n & 63 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = np.zeros(1 << (filter_bits - 6), dtype=np.int64)
    filled = words.toArrow()
    bits[filled.column("w").to_numpy()] = filled.column("b").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    source = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    keyed = source.withColumn("key", F.xxhash64("doc_id", "text"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for hashes, places in all_seeds(token_hashes(tokens(text)), shorts):
                    at = (hashes >> np.uint64(64 - filter_bits)).astype(np.int64)
                    kept = (table[at >> 6] >> (at & 63)) & 1 == 1
                    rows.append((hashes[kept], np.full(int(kept.sum()), key), places[kept]))
            yield _columns(rows, ["hash", "key", "at"])

    passed = keyed.select("key", "text").mapInArrow(hits, "hash long, key long, at long")
    seeds_by_hash = found.select(F.col("hash").alias("h"), "item", "place")
    candidates = passed.join(seeds_by_hash, F.col("hash") == F.col("h")).select("key", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    sized = candidates.join(items.select(F.col("item").alias("i"), "item_id", F.col("text").alias("item_text")), F.col("item") == F.col("i"))
    by_doc = sized.select(F.col("key").alias("k"), "item_id", "item_text", "shift")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, numbers = None, np.empty(0, np.int64)
        for batch in batches:
            rows = []
            for doc, text, item, item_text, shift in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (doc, text) != last:  # rows of a document follow one another
                    last, numbers = (doc, text), token_hashes(tokens(text))
                own, first = token_hashes(tokens(item_text)), max(0, shift)
                if hit := verified(own, numbers[first : shift + len(own)], first, shift):
                    rows.append((doc, item, *hit))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"])

    pairs = keyed.join(by_doc, F.col("key") == F.col("k")).select("doc_id", "text", "item_id", "item_text", "shift")
    return pairs.mapInArrow(check, OUTPUT)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_chars: int = BROADCAST_CHARS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Verified overlaps of documents with benchmark items: ids, first tokens, length and equal tokens.

    An overlap has at least 13 tokens (or the whole item, if that is shorter) of which 80 % are
    equal, position by position. Tokens are runs without white space and ASCII punctuation, A-Z in
    lower case; in scripts without spaces each character (or letter with its marks) is one. Items
    without an id are searched as well and reported with a null one. Null or empty texts and items
    overlap with nothing; repeated rows of a document each give their overlaps; of several overlaps
    on one diagonal the longest counts, the first of equally long ones; other columns do not matter;
    empty tables give an empty result.

    A benchmark of at most ``broadcast_chars`` characters is broadcast and documents are never
    shuffled; a larger one is joined with those windows of the documents that pass a filter.
    """
    known = benchmark.select("item_id", "text")
    size = known.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if size > broadcast_chars:
        return _joined(docs, known, id_col, text_col, filter_bits)
    shared = docs.sparkSession.sparkContext.broadcast(read_index(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in overlaps(tokens(text), index)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(run, OUTPUT)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that overlap with no benchmark item.

    Rows with the same id go or stay together; rows without an id are judged by their text, so that
    those with the same text do.
    """
    # A text's hash stands in for a missing id.
    name, bad = fresh(docs, "__key", "__bad")
    key = F.coalesce(named(id_col).cast("long"), F.xxhash64(F.lit("text of a row without an id"), named(text_col)))
    keyed = docs.withColumn(name, key)
    found = contaminations(keyed, benchmark, name, text_col).select(F.col("doc_id").alias(bad)).distinct()
    return keyed.join(found, F.col(name) == F.col(bad), "left_anti").drop(name)
