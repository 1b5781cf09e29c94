"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are the roles; each line emits a speaker marker (or none) and features of the line: its
length, question marks, whether it is a list item or code, how it opens, and whether its turn ends
with it. The model's counts are taken from rows whose role is known. Viterbi decoding recovers the
roles of unmarked lines, and runs of lines become canonical turns.

A conversation may be arbitrarily long, so it is decoded in blocks of rows. The best score from
any role before a block to any role at its end is a small max-plus matrix; the matrices of a
conversation are chained to fix the roles at the block bounds, and each block is then decoded
between its bounds. That is exact, and no task needs more than one block of lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.expressions import text_of
from terrane.operators.datasets import number_rows
from terrane.operators.joins import BROADCAST_ROWS
from terrane.session import checkpointed

ROLES = ("system", "user", "assistant")
#: Speaker names by role, in lower case.
SPEAKERS = {
    "system": ("system", "developer", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "client", "question", "q", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "agent", "answer", "a", "chatbot", "support"),
}
BY_SPEAKER = {name: k for k, role in enumerate(ROLES) for name in SPEAKERS[role]}
#: Turn numbers of a block; a block is decoded in one task.
BLOCK_TURNS = 1024
#: Rows of a block from which it is cut further.
BLOCK_ROWS = 4096
#: Length classes of a line: binary logarithm of its length, at most so many.
LENGTHS = 12
#: Shapes of a line, by the first pattern found; patterns mean the same to Spark and to Python.
SHAPES = (r"^ *([-*+]|[0-9]+[.)]) ", r"^(```|    |\t)|[;{}] *$")
#: How a line opens: greeting, request, answer, instruction.
OPENINGS = (
    r"^(hi|hello|hey|thanks|thank you|please|good (morning|evening|day)|hallo|danke|bitte|bonjour|merci|hola|gracias)\b",
    r"^(write|explain|give|show|make|list|tell|describe|summari[sz]e|translate|fix|how|what|why|when|where|who|which|can you|could you|would you|i (want|need|have|am)|my)\b",
    r"^(sure|certainly|of course|yes|no|here (is|are)|the|to|in|this|there|you can|first|i'm sorry|as an)\b",
    r"^(you are|you're|act as|always|never|answer|respond|do not|don't|your task)\b",
)
#: Sizes of the features of a line.
FEATURES = (LENGTHS + 1, 2, len(SHAPES) + 1, len(OPENINGS) + 1)
#: Probability that a marker tells the truth, and that a role goes on in the next line of a row.
TRUST, STAY = 0.999999, 0.98
#: Parts into which conversations are dealt where roles are recovered; each is decoded by a model of the others.
FOLDS = 2

#: Fenced names like <|user|>, ### User:, [USER], **User:** and plain User: at the start of a line.
MARKER = re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*([A-Za-z]+)(?:\|>)?|\[([A-Za-z]+)\]|#+\s*([A-Za-z]+)\s*:?(?=\s*$)|\*\*([A-Za-z]+)\s*:?\*\*:?|([A-Za-z]+)\s*:)\s*")


def marker(line: str) -> tuple[int, int]:
    """Role of the line's speaker marker and the marker's length; ``(-1, 0)`` without one."""
    found = MARKER.match(line)
    role = BY_SPEAKER.get(next(x for x in found.groups() if x).lower(), -1) if found else -1
    return (role, found.end()) if role >= 0 else (-1, 0)


def length_class(n: int) -> int:
    return min(LENGTHS, int(math.log2(n + 1)))


_SHAPES, _OPENINGS = ([re.compile(x) for x in patterns] for patterns in (SHAPES, OPENINGS))


def features(line: str) -> tuple[int, ...]:
    """Length class, question, shape and opening of a line."""
    low = line[:80].lower()
    first = lambda patterns, text: next((k for k, x in enumerate(patterns) if x.search(text)), len(patterns))
    return length_class(len(line)), int("?" in line), first(_SHAPES, line), first(_OPENINGS, low)


def feature_columns(line: Column) -> list[Column]:
    """The same as columns."""

    def first(patterns: tuple[str, ...], text: Column) -> Column:
        chain = F
        for k, x in enumerate(patterns):
            chain = chain.when(text.rlike(x), F.lit(k))
        return chain.otherwise(F.lit(len(patterns)))

    size = F.least(F.lit(LENGTHS), F.floor(F.log2(F.length(line) + 1))).cast("int")
    return [size, line.contains("?").cast("int"), first(SHAPES, line), first(OPENINGS, F.lower(F.substring(line, 1, 80)))]


@dataclass(frozen=True)
class Model:
    """Log probabilities: first role, role after role, features of a line given its role, and going on or ending after a line."""

    first: tuple[float, ...]
    step: tuple[tuple[float, ...], ...]
    emit: tuple[tuple[tuple[float, ...], ...], ...]  # [feature][role][value]
    ends: tuple[tuple[float, float], ...]  # [role][whether the turn ends with the line]


@dataclass
class Counts:
    first: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]
    ends: np.ndarray

    @staticmethod
    def none() -> Counts:
        k = len(ROLES)
        return Counts(np.zeros(k), np.zeros((k, k)), [np.zeros((k, n)) for n in FEATURES], np.zeros((k, 2)))

    def model(self) -> Model:
        """Smoothed by one."""
        logs = lambda x: np.log((x + 1.0) / (x + 1.0).sum(axis=-1, keepdims=True)).tolist()
        pairs = lambda x: tuple(map(tuple, logs(x)))
        return Model(tuple(logs(self.first)), pairs(self.step), tuple(pairs(x) for x in self.emit), pairs(self.ends))


def role_number(role: Column) -> Column:
    """0, 1, 2 for the speakers of the three roles; null for any other name."""
    name = F.lower(F.trim(role))
    chain = F
    for k, known in enumerate(ROLES):
        chain = chain.when(name.isin(*SPEAKERS[known]), F.lit(k))
    return chain.otherwise(F.lit(None))


def fold_of(conv: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(folds)).cast("int")


def count(rows: DataFrame, folds: int = 1) -> list[Counts]:
    """Counts over all rows ``(conv_id, turn, role, text)`` with a known role, for each fold of the conversations.

    Successions of roles are counted over rows summed by conversation, turn and role, by an
    equi-join with the turn before, so neither a long conversation nor a turn number that many rows
    share is a burden. Only the counts, at most some thousand numbers, reach the driver.
    """
    known = rows.select(fold_of(F.col("conv_id"), folds).alias("f"), "conv_id", "turn", role_number(F.col("role")).alias("r"), text_of("text").alias("t")).where("r IS NOT NULL")
    found = [Counts.none() for _ in range(folds)]
    lines = known.select("f", "r", F.posexplode(F.split("t", "\n")).alias("i", "line"), (F.size(F.split("t", "\n")) - 1).alias("last"))
    kinds = lines.select("f", "r", (F.col("i") == F.col("last")).cast("int").alias("e"), *[x.alias(f"x{k}") for k, x in enumerate(feature_columns(F.col("line")))])
    for row in kinds.groupBy(*kinds.columns).count().collect():
        at = found[row["f"]]
        at.ends[row["r"], row["e"]] += row["count"]
        for k, table in enumerate(at.emit):
            table[row["r"], row[f"x{k}"]] += row["count"]
    turns = known.groupBy("f", "conv_id", "turn", "r").agg(F.count("*").cast("double").alias("n"))
    after = turns.select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), F.col("r").alias("r2"), F.col("n").alias("n2"))
    for row in turns.join(after, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2"))).groupBy("f", "r", "r2").agg(F.sum(F.col("n") * F.col("n2")).alias("n")).collect():
        found[row["f"]].step[row["r"], row["r2"]] += row["n"]
    before = turns.select(F.col("conv_id").alias("c2"), (F.col("turn") + 1).alias("t2"))
    for row in turns.join(before, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left_anti").groupBy("f", "r").agg(F.sum("n").alias("n")).collect():
        found[row["f"]].first[row["r"]] += row["n"]
    return found


def fit(rows: DataFrame) -> Model:
    """The model of all rows with a known role."""
    return count(rows)[0].model()


def fit_folds(rows: DataFrame, folds: int = FOLDS) -> tuple[Model, ...]:
    """For each fold the model of all the others."""
    counts = count(rows, folds)

    def without(k: int) -> Model:
        rest = [c for i, c in enumerate(counts) if i != k]
        return Counts(sum(c.first for c in rest), sum(c.step for c in rest), [sum(c.emit[j] for c in rest) for j in range(len(FEATURES))], sum(c.ends for c in rest)).model()

    return tuple(without(k) for k in range(folds))


@dataclass
class Lines:
    """Lines of a block: text without marker, whether a turn must begin there, and log scores of the roles."""

    text: list[str]
    begins: list[bool]
    row_start: list[bool]
    score: list[tuple[float, ...]]


def lines_of(rows: list[tuple[str | None, str | None]], model: Model) -> Lines:
    """``rows`` are ``(role, text)``; a known role counts as a marker on the row's first line."""
    out = Lines([], [], [], [])
    agree, differ = math.log(TRUST), math.log((1 - TRUST) / (len(ROLES) - 1))
    for role, text in rows:
        said = BY_SPEAKER.get((role or "").strip().lower(), -1)
        parts = (text or "").split("\n")
        marked = [marker(line) for line in parts]
        for k, (line, (found, width)) in enumerate(zip(parts, marked, strict=True)):
            body = line[width:] if found >= 0 else line
            seen, ends = features(body), int(k == len(parts) - 1 or marked[k + 1][0] >= 0)
            marks = [m for m in (found, said if k == 0 else -1) if m >= 0]
            out.text.append(body)
            out.begins.append(k == 0 or found >= 0)
            out.row_start.append(k == 0)
            out.score.append(tuple(sum(table[r][x] for table, x in zip(model.emit, seen, strict=True)) + model.ends[r][ends] + sum(agree if r == m else differ for m in marks) for r in range(len(ROLES))))
    return out


def _moves(model: Model) -> tuple[tuple[tuple[float, ...], ...], tuple[tuple[float, ...], ...]]:
    """Log scores of role after role where a turn begins, and inside a row."""
    stay, leave = math.log(STAY), math.log((1 - STAY) / (len(ROLES) - 1))
    return model.step, tuple(tuple(stay if a == b else leave for b in range(len(ROLES))) for a in range(len(ROLES)))


def _forward(best: list[float], lines: Lines, moves: tuple, first: int) -> list[float]:
    """Best scores of the roles at the last line, from those before line ``first``."""
    states = range(len(ROLES))
    for begins, score in zip(lines.begins[first:], lines.score[first:], strict=True):
        move = moves[0] if begins else moves[1]
        best = [max(best[a] + move[a][b] for a in states) + score[b] for b in states]
    return best


def block_matrix(lines: Lines, model: Model) -> list[list[float]]:
    """Best log score from each role before the block to each role of its last line."""
    moves, states = _moves(model), range(len(ROLES))
    return [_forward([0.0 if a == b else -math.inf for b in states], lines, moves, 0) for a in states]


def first_vector(lines: Lines, model: Model) -> list[float]:
    """Best log score of each role at the last line of a conversation's first block."""
    start = [x + y for x, y in zip(model.first, lines.score[0], strict=True)]
    return _forward(start, lines, _moves(model), 1)


def viterbi(lines: Lines, model: Model, before: int, last: int) -> list[int]:
    """Best roles of the lines, given the role before the block (-1: it is the first) and that of the last line (-1: any)."""
    moves, states = _moves(model), range(len(ROLES))
    into = model.first if before < 0 else moves[0 if lines.begins[0] else 1][before]
    best, back = [x + y for x, y in zip(into, lines.score[0], strict=True)], []
    for begins, score in zip(lines.begins[1:], lines.score[1:], strict=True):
        move = moves[0] if begins else moves[1]
        from_ = [max(states, key=lambda a: best[a] + move[a][b]) for b in states]  # noqa: B023
        best = [best[a] + move[a][b] + score[b] for b, a in zip(states, from_, strict=True)]
        back.append(from_)
    role = max(states, key=lambda b: best[b]) if last < 0 else last
    roles = [role]
    for pointers in reversed(back):
        role = pointers[role]
        roles.append(role)
    return roles[::-1]


def render(role: str, text: str) -> str:
    """The canonical form of a turn."""
    return f"<|{role}|>\n{text}\n<|end|>"


def canonical(rows: list[tuple[int | None, str | None, str]], model: Model, before: int = -1, last: int = -1) -> list[list[tuple]]:
    """For each row ``(turn, role, text)`` of a block, in order, its ``(turn, part, role, text, rendered)``."""
    found = lines_of([x[1:3] for x in rows], model)
    roles = viterbi(found, model, before, last)
    out: list[list[list]] = []
    for i, (text, begins, starts) in enumerate(zip(found.text, found.begins, found.row_start, strict=True)):
        if starts:
            out.append([])
        if begins or roles[i] != roles[i - 1]:
            out[-1].append([ROLES[roles[i]], [text]])
        else:
            out[-1][-1][1].append(text)

    def turn(number: int | None, part: int, role: str, lines: list[str]) -> tuple:
        text = "\n".join(lines).strip()
        return number, part, role, text, render(role, text)

    return [[turn(row[0], k, role, lines) for k, (role, lines) in enumerate(parts)] for row, parts in zip(rows, out, strict=True)]


OUTPUT = "conv_id long, turn long, part long, role string, given_role string, text string, rendered string"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 2000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*part, strict=True), kinds, strict=True)], names)


def in_blocks(rows: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """The rows with a conversation and a turn, with ``block`` and ``sub`` by which they are decoded.

    A block is a range of turn numbers. Where one has more than ``most`` rows (turn numbers that
    repeat), its rows are numbered in the order of turn, role and text and cut into subs of so many, which
    are chained like blocks: the result is that of one pass. Equal rows are numbered by a mark of their own,
    so that a row that a third of the table repeats is no burden for one task.
    """
    keyed = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    counted = keyed.groupBy("conv_id", "block").agg(F.count("*").alias("n")).where(F.col("n") > most)
    crowded = checkpointed(counted.select(F.col("conv_id").alias("cc"), F.col("block").alias("cb")))
    plain = keyed.withColumn("sub", F.lit(0).cast("long"))
    if crowded.isEmpty():
        return plain
    here = (F.col("conv_id") == F.col("cc")) & (F.col("block") == F.col("cb"))
    order = F.struct("conv_id", "block", "turn", F.coalesce("role", F.lit("")).alias("r"), "text", F.monotonically_increasing_id().alias("mark"))
    many = checkpointed(keyed.join(F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded, here, "left_semi").withColumn("place", order).withColumn("number", F.lit(None).cast("long")))
    numbered = checkpointed(number_rows(many, "place", 0, "number"))
    first = numbered.groupBy(F.col("conv_id").alias("fc"), F.col("block").alias("fb")).agg(F.min("number").alias("low"))
    cut = numbered.join(first, (F.col("conv_id") == F.col("fc")) & (F.col("block") == F.col("fb"))).withColumn("sub", F.floor((F.col("number") - F.col("low")) / most))
    return plain.join(crowded, here, "left_anti").unionByName(cut.select(*plain.columns))


def format_chat(conversations: DataFrame, model: Model | None = None, hide_roles: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    r"""``(conv_id, turn, part, role, given_role, text, rendered)``: the canonical turns of all conversations.

    ``conversations`` has ``(conv_id, turn, role, text)`` rows; a raw transcript is one row with a
    null role. Rows are taken in the order of turn number, role and text. A canonical turn begins with each row, each
    speaker marker and each change of role inside a row; ``part`` numbers the turns that a row gives.
    Rows whose role is null or unknown get the role that Viterbi recovers. With ``hide_roles`` no
    row's own role is looked at: conversations are dealt into ``FOLDS`` parts by a hash of their id,
    and each is decoded from its texts alone by the model of the others; ``given_role`` stays beside
    the recovered one. Null text is an empty one and gives an empty turn; a row without a
    conversation or a turn number is a transcript of its own; repeated rows give repeated turns;
    other columns do not matter; an empty table gives an empty result.

    Conversations within one block, nearly all, are decoded in one pass over sorted partitions.
    Longer ones pass twice: once for the matrices of their blocks, once between the bounds; of a
    conversation only its matrices, a hundred bytes for a thousand turns, meet in one task.
    """
    given = F.col("role").cast("string")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), given.alias("given_role"), (F.lit(None).cast("string") if hide_roles else given).alias("role"), text_of("text").alias("text"),
        (fold_of(F.col("conv_id").cast("long"), FOLDS) if hide_roles and model is None else F.lit(0)).alias("fold"),
    )
    known = rows.select("conv_id", "turn", F.col("given_role").alias("role"), "text")
    models = (model,) if model else fit_folds(known) if hide_roles else (fit(known),)
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    k = len(ROLES)
    keyed = in_blocks(rows, block_rows)
    spans = keyed.groupBy("conv_id").agg(F.min(F.struct("block", "sub")).alias("low"), F.max(F.struct("block", "sub")).alias("high"))
    long_ones = checkpointed(spans.where("low <> high").select(F.col("conv_id").alias("long_conv")))
    long_rows = keyed.join(long_ones, F.col("conv_id") == F.col("long_conv"), "left_semi")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((conv, number, part, role, given, body, rendered) for conv, turn, given, role, text, fold in _rows(batches) for (parts,) in [canonical([(turn, role, text)], models[fold])] for number, part, role, body, rendered in parts)
        return _batches(found, names, _KINDS)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (conv, block, sub), group in groupby(_rows(batches), key=lambda x: x[:3]):
                own = list(group)
                model = models[own[0][6]]
                found = lines_of([x[4:6] for x in own], model)
                yield conv, block, sub, first_vector(found, model), [x for row in block_matrix(found, model) for x in row]

        return _batches(each(), ["conv_id", "block", "sub", "first", "matrix"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (conv, _, _, before, last), group in groupby(_rows(batches), key=lambda x: (*x[:3], *x[8:])):
                own = list(group)
                for row, parts in zip(own, canonical([x[3:6] for x in own], models[own[0][6]], before, last), strict=True):
                    yield from ((conv, turn, part, role, row[7], text, rendered) for turn, part, role, text, rendered in parts)

        return _batches(each(), names, _KINDS)

    def bounds(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "sub"])
        matrices = [np.array(x).reshape(k, k) for x in group["matrix"]]
        best, back = np.array(group["first"].iloc[0]), []
        for matrix in matrices[1:]:
            paths = best[:, None] + matrix
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0)
        last = [int(best.argmax())]
        for pointers in reversed(back):
            last.append(int(pointers[last[-1]]))
        last = last[::-1]
        return pd.DataFrame({"b_conv": group["conv_id"], "b_block": group["block"], "b_sub": group["sub"], "before": [-1, *last[:-1]], "last": last})

    def in_order(df: DataFrame, *more: str) -> DataFrame:
        columns = ["conv_id", "block", "sub", "turn", "role", "text", "fold", "given_role", *more]
        return df.select(*columns).repartition("conv_id", "block", "sub").sortWithinPartitions("conv_id", "block", "sub", "turn", F.coalesce("role", F.lit("")), "text")

    if long_ones.isEmpty():
        placed = keyed.withColumns({"before": F.lit(-1), "last": F.lit(-1)})
    else:
        edges = in_order(long_rows).mapInArrow(summary, "conv_id long, block long, sub long, first array<double>, matrix array<double>")
        edges = checkpointed(edges.groupBy("conv_id").applyInPandas(bounds, "b_conv long, b_block long, b_sub long, before int, last int"))
        joined = keyed.join(edges, (F.col("conv_id") == F.col("b_conv")) & (F.col("block") == F.col("b_block")) & (F.col("sub") == F.col("b_sub")), "left")
        placed = joined.withColumns({"before": F.coalesce("before", F.lit(-1)), "last": F.coalesce("last", F.lit(-1))})
    whole = in_order(placed, "before", "last").mapInArrow(decode, OUTPUT)
    return whole.union(rows.where("conv_id IS NULL OR turn IS NULL").mapInArrow(alone, OUTPUT))
