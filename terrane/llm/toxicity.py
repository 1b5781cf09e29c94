r"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns words into symbols: insult, threat, target (the reader), negation, report, quote. Four
sequential transducers read a clause of symbols: quotes, reported speech, negation (three words
wide) and target (six words before or after). They are composed into one machine, whose output
says of every insult and threat whether it is plain, aimed at somebody, negated or reported; the weights
of the words add up by these kinds. A logistic curve over the sums gives the score.

The lexicon starts from fixed words and learns stems and words from labelled rows: among all words
and beginnings of words of a bounded sample those are taken, one after the other, that explain most
toxic rows which earlier ones do not explain yet, as long as the surplus is beyond chance for the number
of candidates. So copies of one toxic text add no words once a few of its words are known.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.expressions import fresh, named, text_of
from terrane.session import checkpointed

# Fixed words. Seeds of the lexicon; a learned weight replaces theirs where labelled rows have the word.
INSULTS = "idiot idiots moron morons imbecile stupid dumb loser losers scum trash pathetic worthless disgusting filth vermin bastard bitch asshole fool coward idiota imbécil estúpido estúpida basura escoria idiotin dummkopf abschaum arschloch mistkerl imbécile crétin ordure salaud connard".split()
THREATS = "kill murder hurt stab shoot burn destroy beat strangle hang umbringen töten verletzen erschießen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself ya u they them du dich dir dein deine ihr euch tu te toi vous votre ton usted ustedes tú ti vosotros".split()
NEGATIONS = "not never no nobody cannot isn't aren't don't won't nicht nie kein keine ne pas jamais non nunca jamás tampoco".split()
REPORTS = "said says say called calls wrote writes told claims quoted sagte sagt nannte schrieb dit disait appelait dijo dice llamó escribió".split()

#: Kinds of matches: an insult or a threat, each plain, aimed, negated or reported.
KINDS = ("insult", "insult_aimed", "insult_negated", "insult_reported", "threat", "threat_aimed", "threat_negated", "threat_reported")
#: What the grammar expects of each kind before any row is seen, and of a text without a match.
PRIOR, PRIOR_BASE = (2.5, 4.0, 0.5, 0.8, 0.5, 3.0, 0.1, 0.3), -3.0
#: Labelled rows that the lexicon and the curve are fitted on, on average.
SAMPLE = 16_000
#: Lengths of learned beginnings of words, and candidates that are compared one by one.
STEMS, CANDIDATES = (3, 4, 5, 6, 7), 4000
#: Learned terms have at least so many toxic rows, and a chance below this over all candidates.
LEAST_ROWS, CHANCE = 6, 1e-3
#: A row is explained by so many chosen terms.
DEPTH = 3
NEGATION_WORDS, TARGET_WORDS = 3, 6
#: Words whose symbols a task remembers.
CACHE = 300_000
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Letters with digits or signs between them: 1d1ot, cl0wn.
DISGUISED = re.compile(r"(?<![^\W_])(?=[^\W_@$]*[0-9@$])(?=[0-9@$]*[^\W\d_])[^\W_](?:[^\W_]|[@$](?=[^\W_]))+")
PLAIN = str.maketrans("013457@$", "oieastas")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»„]")
CLAUSE = re.compile(r"[.!?;:\n\r…]+")


class Transducer:
    """A sequential transducer: ``step(state, symbol)`` gives the next state and the symbols written."""

    def __init__(self, start, step, end=lambda state: ()):
        self.start, self.step, self.end = start, step, end

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads."""

        def feed(state, symbols):
            out = []
            for symbol in symbols:
                state, written = other.step(state, symbol)
                out += written
            return state, tuple(out)

        def step(state, symbol):
            mine, written = self.step(state[0], symbol)
            theirs, out = feed(state[1], written)
            return (mine, theirs), out

        def end(state):
            theirs, out = feed(state[1], self.end(state[0]))
            return (*out, *other.end(theirs))

        return Transducer((self.start, other.start), step, end)


# Symbols: o other, i insult, h threat, t target, n negation, r report, q quote. Of i and h: upper case where
# aimed, with a mark where negated (-) or reported (>). "+" says that the plain match before is aimed after all.
def quotes() -> Transducer:
    """Inside quotes insults and threats are reported; quotes end with the clause."""
    return Transducer(False, lambda s, x: (not s, ("o",)) if x == "q" else (s, (x + ">",) if s and x in "ih" else (x,)))


def reports() -> Transducer:
    """After a verb of saying what follows in the clause is reported."""
    return Transducer(False, lambda s, x: (True, ("o",)) if x == "r" else (s, (x + ">",) if s and x in "ih" else (x,)))


def negations(width: int = NEGATION_WORDS) -> Transducer:
    """A negation takes back what follows it within ``width`` words."""
    return Transducer(0, lambda s, x: (width, ("o",)) if x == "n" else (max(0, s - 1), (x + "-",) if s and x in "ih" else (x,)))


def targets(width: int = TARGET_WORDS) -> Transducer:
    """An insult or threat with a target within ``width`` words before or after it is aimed."""

    def step(state, x):
        since, waiting = state  # words left in which a target counts; of plain matches that wait for one
        if x == "t":
            return (width, ()), ("o", *("+" + k for _, k in waiting))
        waiting = tuple((left - 1, k) for left, k in waiting if left > 1)
        if x in ("i", "h"):
            if since:
                return (since - 1, waiting), (x.upper(),)
            return (0, (*waiting, (width, x))[-width:]), (x,)
        return (max(0, since - 1), waiting), (x,)

    return Transducer((0, ()), step)


GRAMMAR = quotes().then(reports()).then(negations()).then(targets())
_KIND = {"i": 0, "I": 1, "i-": 2, "i>": 3, "h": 4, "H": 5, "h-": 6, "h>": 7}


class Machine:
    """The composed grammar with its transitions remembered as they are met."""

    def __init__(self, grammar: Transducer = GRAMMAR):
        self.grammar, self.arcs = grammar, {}

    def read(self, symbols: list[tuple[str, float]], sums: list[float]) -> None:
        """Adds the weights of the matches of a clause to ``sums``, by kind."""
        state, plain = self.grammar.start, {"i": [], "h": []}
        for symbol, weight in symbols:
            if (arc := self.arcs.get((state, symbol))) is None:
                arc = self.arcs[state, symbol] = self.grammar.step(state, symbol)
            state, written = arc
            for x in written:
                if x in _KIND:
                    sums[_KIND[x]] += weight
                    if x in plain:
                        plain[x].append(weight)
                elif x[0] == "+" and plain[x[1]]:
                    kind, back = _KIND[x[1]], plain[x[1]].pop()
                    sums[kind] -= back
                    sums[kind + 1] += back


@dataclass
class Model:
    """Weights of words and stems (as ``stem*``), and the curve over the kinds of matches."""

    terms: dict[str, float]
    curve: tuple[float, ...] = PRIOR
    base: float = PRIOR_BASE
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, 1.0))

    def reader(self) -> Reader:
        return Reader(self)

    def score(self, sums: list[float]) -> float:
        x = self.base + sum(c * math.log1p(max(0.0, s)) for c, s in zip(self.curve, sums, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


class Reader:
    """Reads texts with one model; remembers the symbols of words."""

    def __init__(self, model: Model):
        self.model, self.machine, self.known = model, Machine(), {}
        self.fixed = {w: (s, 0.0) for s, words in (("t", TARGETS), ("n", NEGATIONS), ("r", REPORTS)) for w in words}
        self.fixed |= dict.fromkeys('"“”«»„', ("q", 0.0))

    def symbol(self, word: str) -> tuple[str, float]:
        if (found := self.known.get(word)) is None:
            terms = self.model.terms
            weight = max([terms.get(word, 0.0), *(terms.get(word[:n] + "*", 0.0) for n in STEMS if n <= len(word))])
            if weight > 0:
                found = ("i", weight)
            elif word in self.model.threats:
                found = ("h", self.model.threats[word])
            else:
                found = self.fixed.get(word, ("o", 0.0))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = found
        return found

    def sums(self, text: str) -> list[float]:
        """Weights of the matches of a text, by kind."""
        out, symbol = [0.0] * len(KINDS), self.symbol
        text = plain(text)
        if not any(symbol(w)[0] in "ih" for w in set(WORD.findall(text))):
            return out
        for clause in CLAUSE.split(text):
            symbols = [symbol(w) for w in TOKEN.findall(clause)]
            if any(s in "ih" for s, _ in symbols):
                self.machine.read(symbols, out)
        return out


def plain(text: str) -> str:
    """In lower case, with digits and signs inside words read as the letters they stand for."""
    low = text.lower()
    return DISGUISED.sub(lambda m: m[0].translate(PLAIN), low) if any(c in low for c in "013457@$") else low


def candidates(text: str) -> set[str]:
    """Words of a text of 3 to 30 letters, and beginnings of them marked ``*``."""
    words = {w for w in WORD.findall(plain(text)) if 2 < len(w) <= 30}
    return words | {w[:n] + "*" for w in words for n in STEMS if n < len(w)}


def surplus(toxic: int, clean: int, share: float) -> float:
    """Natural logarithm of the chance of ``toxic`` or more toxic rows among all with a term (Chernoff's bound)."""
    n = toxic + clean
    p = toxic / n
    if p <= share:
        return 0.0
    return -n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0))


def weight_of(toxic: float, clean: float, share: float) -> float:
    """Between 0 and 1: how far the odds of a row with the term lie above the odds of any row."""
    odds = math.log((toxic + 0.5) / (clean + 0.5)) - math.log(share / (1 - share))
    return max(0.0, min(1.0, odds / 4))


def cover(rows: list[tuple[bool, list[int]]], terms: list[str], tried: int) -> dict[int, tuple[int, int]]:
    """Terms by what they explain: of each chosen one its toxic and clean rows.

    ``rows``: whether it is toxic, numbers of its terms. The next term is the one least likely by
    chance among the rows that fewer than ``DEPTH`` chosen terms are in, and no stem of a chosen one nor chosen
    by its stem; ``tried`` is the number of all candidates.
    """
    by: dict[int, set[int]] = {}
    for r, (_, own) in enumerate(rows):
        for t in own:
            by.setdefault(t, set()).add(r)
    toxic = {r for r, (x, _) in enumerate(rows) if x}
    share = len(toxic) / max(1, len(rows))
    chosen: dict[int, tuple[int, int]] = {}
    if not 0 < share < 1:
        return chosen
    limit, explained = math.log(CHANCE / max(1, tried)), [0] * len(rows)
    hits = {t: (len(rs & toxic), len(rs)) for t, rs in by.items()}
    while hits:
        bounds = {t: surplus(a, n - a, share) for t, (a, n) in hits.items() if a >= LEAST_ROWS}
        best = min(bounds, key=lambda t: (bounds[t], terms[t]), default=None)
        if best is None or bounds[best] > limit:
            break
        # A longer term that explains nearly as much says more exactly what is meant.
        root, enough = terms[best].rstrip("*"), min(limit, 0.9 * bounds[best])
        best = max((t for t, x in bounds.items() if x <= enough and terms[t].startswith(root)), key=lambda t: (len(terms[t].rstrip("*")), "*" not in terms[t], -bounds[t]))
        all_toxic = len(by[best] & toxic)
        chosen[best] = (all_toxic, len(by[best]) - all_toxic)
        for r in by[best]:
            explained[r] += 1
            if explained[r] == DEPTH:
                for t in rows[r][1]:
                    if t in hits:
                        a, n = hits[t]
                        hits[t] = (a - (r in toxic), n - 1)
        root = terms[best].rstrip("*")
        akin = lambda t: (own := terms[t].rstrip("*")).startswith(root) or root.startswith(own)
        hits = {t: x for t, x in hits.items() if x[0] >= LEAST_ROWS and not akin(t)}
    return chosen


def curve_of(sums: np.ndarray, toxic: np.ndarray, strength: float = 1.0) -> tuple[float, tuple[float, ...]]:
    """The logistic curve nearest to the rows, drawn to ``PRIOR`` with the given strength; weights stay at or above zero."""
    x = np.column_stack([np.ones(len(sums)), np.log1p(np.maximum(sums, 0))])
    prior = np.array([PRIOR_BASE, *PRIOR])
    pull = np.array([1e-3, *[strength] * len(PRIOR)])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - toxic) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), tuple(float(v) for v in w[1:])


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of the id, written as text, leaves 2 when divided by four; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task the terms with their toxic and clean rows; of terms that no toxic row has, only their number matters."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counts[not toxic].update(candidates(text.as_py()))
    names = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(names), 100_000):
        some = names[at : at + 100_000]
        yield pa.record_batch([pa.array(some, pa.string()), *(pa.array([c[t] for t in some], pa.int64()) for c in counts)], names=["term", "toxic", "clean"])


def _matches(number: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(number[t] for t in candidates(x.as_py()) & number.keys()) for x in batch.column(0)]
            yield pa.record_batch([batch.column(1), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "own"])

    return run


def _sums(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            yield pa.record_batch([batch.column(1), pa.array([reader.sums(x.as_py()) for x in batch.column(0)], pa.list_(pa.float64()))], names=["toxic", "sums"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Lexicon and curve from about ``sample`` labelled rows (all, if fewer), chosen by a hash of their ids.

    Rows without a label or an id teach nothing; an id with several labels counts as toxic if one says
    so. Without labelled rows the model has the fixed words and the expected curve.
    """
    known = labels.where(named(label_col).isNotNull() & named(id_col).isNotNull()).groupBy(named(id_col).alias("id")).agg((F.max(named(label_col).cast("int")) > 0).alias("toxic"))
    some = checkpointed(known)
    rate = int(min(1.0, sample / max(1, some.count())) * 1_000_000)
    chosen = F.broadcast(some.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < rate))
    # Repeated rows of one text teach once.
    texts = docs.select(named(id_col).alias("id"), text_of(named(text_col)).alias("text")).join(chosen, "id").groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = checkpointed(texts.select("text", "toxic"))
    n, toxic = (x or 0 for x in rows.agg(F.count("*"), F.sum(F.col("toxic").cast("int"))).first())
    terms = dict.fromkeys(INSULTS, 0.75)
    threats = dict.fromkeys(THREATS, 1.0)
    if not 0 < toxic < n:
        return Model(terms, threats=threats)
    share = toxic / n
    counted = rows.mapInArrow(_counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = checkpointed(counted.where((F.col("toxic") > 0) & ((F.col("toxic") >= LEAST_ROWS) | F.col("term").isin(INSULTS))))
    tried = counted.count()
    p = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    surplus_of = (F.col("toxic") + F.col("clean")) * (p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0))
    best = counted.where(p > share).orderBy(surplus_of.desc(), "term").limit(CANDIDATES).collect()
    names = [r["term"] for r in best]
    found = rows.mapInArrow(_matches({t: k for k, t in enumerate(names)}), "toxic boolean, own array<int>").collect()
    chosen_terms = cover([(r["toxic"], r["own"]) for r in found], names, tried)
    for r in counted.where(F.col("term").isin(INSULTS)).collect():
        terms[r["term"]] = weight_of(r["toxic"] + 1.5, r["clean"] + 0.1, share)
    terms |= {names[t]: w for t, (a, b) in chosen_terms.items() if (w := weight_of(a, b, share)) > 0}
    model = Model(terms, threats=threats)
    sums = rows.mapInArrow(_sums(model), "toxic boolean, sums array<double>").collect()
    model.base, model.curve = curve_of(np.array([r["sums"] for r in sums]), np.array([r["toxic"] for r in sums], float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each document: id, score, 1 if it reaches the threshold, and the sums of matched weights by kind.

    Null text is an empty one and has the score of a text without a match. Rows that occur again are scored
    again; other columns do not matter; an empty table gives an empty result. Whole texts are read.
    """
    key, text = fresh(docs.select(), "doc_id", "text")
    texts = docs.select(named(id_col).alias(key), text_of(named(text_col)).alias(text))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            sums = [reader.sums(x.as_py()) for x in batch.column(1)]
            scores = [model.score(s) for s in sums]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), *(pa.array([s[k] for s in sums], pa.float64()) for k in range(len(KINDS)))]
            yield pa.record_batch(columns, names=[key, "score", "predicted", *KINDS])

    return texts.mapInArrow(run, f"doc_id {kind}, score double, predicted int, " + ", ".join(f"{k} double" for k in KINDS))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's scores; what is held out teaches nothing."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
