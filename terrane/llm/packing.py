"""Packing of tokenised documents into sequences by first-fit decreasing with a tournament tree.

Every document becomes a run of token ids that ends with id 1. It is cut after each full
sequence; what remains is one piece. Pieces are dealt to groups at random (by a hash of the
piece and its place in the table), and each group is packed on its own: longest piece first, each into the first bin
that has room. The first such bin is found by descending a tournament tree whose nodes hold the
largest capacity below them, so a piece costs log(bins).

Only the lengths and checksums of pieces are shuffled, never the ids or the texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import checkpointed

SEQUENCE = 2048
END_ID = 1
#: Pieces that one group holds on average; a group is packed in one task.
GROUP_PIECES = 4000
#: Words whose ids a worker remembers; beyond it, it starts anew.
CACHE_WORDS = 400_000


class WordIds(dict):
    """Ids of words between white space, as little-endian unsigned 32-bit bytes.

    The vocabulary is byte-pair encoding with word ends whose normalisation and splitting never
    cross white space, so a text's ids are its words' ids in order. Words of plain letters, digits
    and punctuation of the first 256 code points are encoded by a byte-pair encoder over the same
    merges; every other word goes through the tokenizer itself. The encoder writes the end of a
    word as byte FF, which no UTF-8 text has, and joins it to the last byte first. It merges by
    the joined string where the tokenizer merges by the pair; both agree if each entry of the
    vocabulary encodes to itself, which ``agrees`` checks.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, merges, suffix = model["vocab"], model["merges"], model["end_of_word_suffix"]
        to_byte = {char: byte for byte, char in byte_characters().items()}
        ranks, self.ids = {bytes([b]): b for b in range(256)}, {}

        def put(token: str) -> bytes:
            word = token.removesuffix(suffix)
            raw = bytes(to_byte[c] for c in word) + (b"\xff" if word != token else b"")
            self.ids[ranks.setdefault(raw, len(ranks))] = vocabulary[token]
            return raw

        for char in to_byte:
            put(char)
            put(char + suffix)
        self.merged = [put("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
        self.coder = tiktoken.Encoding("word-ends", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.piece = self.coder._core_bpe.encode_single_piece
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.bytes = {k: v.to_bytes(4, "little") for k, v in self.ids.items()}
        # No blanks or controls, and not < or |, which special tokens are made of.
        self.plain = re.compile(r"[!-;=-{}~¡-¬®-ÿ]+").fullmatch
        self.marks = {x: b"".join([self.bytes[k] for k in self.piece(x.encode() + b"\xff")]) if x else b"" for x in ("", ".", ",")}
        self.letters = re.compile(r"([a-zß-öø-ÿ]+)([.,]?)").fullmatch

    def agrees(self) -> bool:
        """Whether every merged entry of the vocabulary encodes to itself."""
        return all(len(self.piece(raw)) == 1 and self.coder.encode_single_token(raw) == self.piece(raw)[0] for raw in self.merged) and all(len(self.slow(raw)) == 1 for raw in self.merged)

    def slow(self, raw: bytes) -> list[int]:
        """Parts of an entry by repeated merging of the lowest rank below the entry's own."""
        rank = self.coder._mergeable_ranks
        own, parts = rank[raw], [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            found = [(rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in rank]
            best = min(found, default=(own + 1, 0))
            if best[0] > own:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [rank[x] for x in parts]

    def __missing__(self, word: str) -> bytes:
        low = word.lower()
        if simple := self.letters(low):
            stem, mark = simple.groups()
            if mark or low != word:
                found = self[stem] + self.marks[mark]
            else:
                number = self.bytes
                found = b"".join([number[k] for k in self.piece(low.encode() + b"\xff")])
        elif self.plain(word):
            found = b"".join([self.bytes[k] for part in self.split(low) for k in self.piece(part.encode() + b"\xff")])
        else:
            found = b"".join([k.to_bytes(4, "little") for k in self.tokenizer.encode(word, add_special_tokens=False).ids])
        if len(self) >= self.limit:
            self.clear()
        self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


def byte_characters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def word_ids(path: str) -> WordIds:
    """One encoder in each Python worker."""
    return WordIds(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(ids: bytes, size: int = SEQUENCE) -> list[tuple[int, int, int]]:
    """``(start, length, crc32)`` of the pieces of a document's ids (four bytes each)."""
    n = len(ids) // 4
    return [(a, min(size, n - a), zlib.crc32(ids[4 * a : 4 * (a + size)])) for a in range(0, n, size)]


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, row)`` of every piece of every document.

    ``row`` numbers the rows of a task, so that equal rows are not dealt to the same group.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = word_ids(path or default_path()), 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.encode(text or "") + end
                rows += [(doc, *piece, len(ids) // 4, number) for piece in cut(ids, size)]
                number += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def first_fit_decreasing(lengths: np.ndarray, size: int = SEQUENCE) -> np.ndarray:
    """The bin of each piece; ``lengths`` must be sorted, longest first, and none over ``size``.

    ``tree[1]`` is the root; the leaves from ``leaves`` on are the capacities left in the bins.
    """
    n, bins = len(lengths), np.empty(len(lengths), dtype=np.int64)
    leaves = 1 << max(n - 1, 0).bit_length()
    tree = [size] * (2 * leaves)
    for k, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        bins[k] = node - leaves
        tree[node] -= length
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins


def pack(parts: DataFrame, size: int = SEQUENCE, group_pieces: int = GROUP_PIECES, seed: int = 11) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces.

    The number of groups follows from a count of the pieces, so that a group has about
    ``group_pieces`` of them at any size of the corpus; a group leaves at most one sequence far
    from full.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    groups = max(1, round(parts.count() / group_pieces))
    salt = ["row"] if "row" in parts.columns else []
    # pandas has no long column with nulls, so a missing id travels as a flag.
    dealt = parts.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), *names[1:], F.col("doc_id").isNull().alias("no_id"), F.pmod(F.xxhash64(*names, *salt, F.lit(seed)), F.lit(groups)).alias("part"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "no_id", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        bins = first_fit_decreasing(rows["length"].to_numpy(), size)
        before = rows["length"].groupby(bins).cumsum() - rows["length"]
        return rows[[*names, "no_id"]].assign(sequence_id=rows["part"] * (1 << 32) + bins, offset=before)

    out = dealt.groupBy("part").applyInPandas(run, f"{', '.join(f'{x} long' for x in names)}, no_id boolean, sequence_id long, offset long")
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), *names[1:], "sequence_id", "offset")


def packed(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed pieces of all documents.

    ``start`` ids of the document lie before a piece of ``length`` ids; ``doc_tokens`` counts the
    document's ids with the final id 1; ``sequence_id`` and ``offset`` place the piece, without gaps
    from offset 0. Null text is an empty one: a single piece with id 1. Repeated rows are packed
    each on its own, rows without a document id like any other; other columns do not matter; an empty table gives an empty result.
    """
    return pack(checkpointed(pieces(docs, path, id_col, text_col)))
