"""Quality rules: a short-circuit cascade ordered by rejections per second (DataFrame functions only).

Every rule is one Boolean column over a text and its words; a document is rejected if any rule
rejects it. The order of the rules never changes the verdict, only what it costs: ``order_rules``
measures each rule's cost and selectivity on a bounded sample and puts first the rule that rejects
most per second, then the one that rejects most of what is left, and so on; ``cascade`` builds one
CASE expression whose later branches are not evaluated for rows that an earlier one has rejected.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.expressions import bind, text_of, words_of

SYMBOLS = "#*$%&|<>"


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words_of(text), "")).cast("long")


def symbols(text: Column) -> Column:
    """Characters of ``#*$%&|<>``."""
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(text: Column) -> Column:
    r"""Lines (split at ``\n``) that have a word and equal an earlier line."""
    return bind(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(hashes: Column) -> Column:
    """Words inside 3-word windows whose hash occurs more than once; ``hashes`` has one entry a window.

    The windows are sorted by hash, so equal ones are neighbours; their positions, sorted again,
    give the covered words as a union of intervals of length three: n log n for any text.
    """
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(rows: Column) -> Column:
        same = lambda e, k: (F.get(rows, k - 1)["h"] == e["h"]) | (F.get(rows, k + 1)["h"] == e["h"])
        return F.sort_array(F.transform(F.filter(rows, same), lambda e: e["i"]))

    def span(places: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total"))
        return F.aggregate(places, first, step, lambda a: a["total"])

    return bind(bind(ranked, again), span)


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes within one text.
    """

    def of(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        hashes = F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return bind(hashes, lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(_covered(h)))

    return bind(words, of).cast("long")


def capital_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{Lu}+", ""))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


@dataclass(frozen=True)
class Rule:
    """A name and the column that is true for a text and its words which the rule rejects (never null)."""

    name: str
    rejects: Callable[[Column, Column], Column]


#: A text without words, or with fewer than 50, says too little.
TOO_SHORT = Rule("too_short", lambda t, w: F.size(w) < 50)
#: More than half of the words lie in windows that the text repeats.
REPETITIVE = Rule("repetitive", lambda t, w: 100 * repeated_words(w) > 50 * F.size(w))
#: More than one symbol for ten words: mark-up, tables or noise rather than prose.
SYMBOL_NOISE = Rule("symbol_noise", lambda t, w: 10 * symbols(t) > F.size(w))
#: More than one exclamation mark for ten words.
EXCLAIMING = Rule("exclaiming", lambda t, w: 10 * F.length(F.regexp_replace(t, "[^!]+", "")) > F.size(w))
#: More than four capitals in ten letters.
SHOUTING = Rule("shouting", lambda t, w: 10 * capital_letters(t) > 4 * letters(t))
#: At least five lines, more than four in ten of them repeated.
SAME_LINES = Rule("same_lines", lambda t, w: bind(lines_with_words(t), lambda x: (F.size(x) >= 5) & (10 * (F.size(x) - F.size(F.array_distinct(x))) > 4 * F.size(x))))
#: Words of less than two or more than twelve and a half code points on average.
ODD_WORDS = Rule("odd_words", lambda t, w: bind(F.length(F.array_join(w, "")), lambda n: (n < 2 * F.size(w)) | (2 * n > 25 * F.size(w))))

BASE_RULES = (TOO_SHORT, REPETITIVE)
RULES = (*BASE_RULES, SYMBOL_NOISE, EXCLAIMING, SHOUTING, SAME_LINES, ODD_WORDS)


def sample_texts(docs: DataFrame, text_col: str = "text", rows: int = 500, longest: int = 100_000, files: int = 8, seed: int = 7) -> list[str]:
    """At most ``rows`` texts of at most ``longest`` characters, at random from ``files`` random files of the table.

    So a sorted table does not show its head only. The other files are not read. A table that is not
    a plain scan of files gives rows of its first partitions.
    """
    texts = docs.select(text_of(text_col).alias("t")).where(F.length("t") <= longest)
    paths = sorted(docs.inputFiles())
    if len(paths) > files:
        try:
            chosen = [path.rsplit("/", 1)[-1] for path in random.Random(seed).sample(paths, files)]
            few = docs.where(F.col("_metadata.file_name").isin(chosen))
            texts = few.select(text_of(text_col).alias("t")).where(F.length("t") <= longest)
        except AnalysisException:  # the rows of these files have been through other operators
            pass
    n = texts.count() if paths else 0
    found = [r[0] for r in (texts.sample(min(1.0, 1.5 * rows / n), seed) if n else texts).take(rows)]
    return found or [r[0] for r in docs.select(text_of(text_col).alias("t")).where(F.length("t") <= longest).take(rows)]


def greedy_order(rejects: list[tuple[bool, ...]], costs: list[float]) -> list[int]:
    """Numbers of the rules: each next one rejects most, for its cost, of what the rules before it leave; ties as given."""
    left, order, rest = rejects, [], list(range(len(costs)))
    while rest:
        best = max(rest, key=lambda k: (sum(row[k] for row in left) / costs[k], -k))
        order.append(best)
        rest.remove(best)
        left = [row for row in left if not row[best]]
    return order


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", rows: int = 500) -> tuple[Rule, ...]:
    """The rules by rejections per second among the texts that the rules before them leave.

    Costs and rejections are measured on a sample of at most ``rows`` texts, which is kept in memory with its words. Each
    rule is timed twice over it; the lower time counts, less that of a job that only reads the sample, and at
    least a twentieth of it. An empty table keeps the given order.
    """
    spark = docs.sparkSession
    texts = sample_texts(docs, text_col, rows)
    if not texts:
        return rules
    # One partition, and no rule can be folded into a constant; the words are split once for all rules.
    sample = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", words_of(F.col("t")).alias("w")).cache()
    try:

        def timed(test: Callable[[Column, Column], Column]) -> float:
            best = float("inf")
            for _ in range(2):
                began = time.perf_counter()
                sample.agg(F.count_if(test(F.col("t"), F.col("w")))).first()
                best = min(best, time.perf_counter() - began)
            return best

        base = timed(lambda t, w: F.size(w) < 0)
        costs = [max(timed(rule.rejects) - base, base / 20) for rule in rules]
        answers = F.array(*[rule.rejects(F.col("t"), F.col("w")) for rule in rules])
        rejects = [tuple(row[0]) for row in sample.select(answers).collect()]
        return tuple(rules[k] for k in greedy_order(rejects, costs))
    finally:
        sample.unpersist()


def with_words(text: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over the words of the text, which are split once for all rules."""
    return bind(words_of(text), body)


def cascade(rules: tuple[Rule, ...], text: Column, words: Column) -> Column:
    """True if any rule rejects the text; rules after the first that rejects it are not evaluated."""
    chain = F
    for rule in rules:
        chain = chain.when(rule.rejects(text, words), F.lit(True))
    return chain.otherwise(F.lit(False)) if rules else F.lit(False)


def rejection(rules: tuple[Rule, ...], text: Column) -> Column:
    """The cascade over a text."""
    return with_words(text, lambda w: cascade(rules, text, w))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: its counts, whether a base rule rejects it, and the verdict.

    The counts are wanted for every document, so the base rules, which are comparisons of counts,
    come first in the cascade; the others run, in the order measured, for what these leave. Null
    text is an empty one (no words, rejected). Repeated rows are judged one by one, columns other
    than the id and the text do not matter, an empty table gives an empty result.
    """
    rest = order_rules(docs, tuple(rule for rule in rules if rule not in BASE_RULES), text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    text = F.col("t")

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols(text).alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def judged(w: Column) -> Column:
        failed = lambda m: (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        verdict = lambda m: F.when(failed(m), F.lit(False)).otherwise(~cascade(rest, text, w))
        return bind(counts(w), lambda m: F.struct(*[m[c].alias(c) for c in fields], failed(m).alias("base_failed"), verdict(m).alias("kept")))

    return texts.select("doc_id", with_words(text, judged).alias("m")).select("doc_id", "m.*")


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns; of the rules those that reject most for their cost come first.

    A null text is an empty one and goes. Rows are judged one by one, so repeated rows stay or go together and
    there are no ties; other columns do not matter; an empty table gives an empty result.
    """
    return docs.where(~rejection(order_rules(docs, rules, text_col), text_of(text_col)))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM w WHERE len(w) > 2),
k AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, t, w, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             10 * n_symbols > n_words OR 10 * length(regexp_replace(t, '[^!]', '', 'g')) > n_words
             OR 10 * length(regexp_replace(t, '\P{Lu}', '', 'g')) > 4 * length(regexp_replace(t, '\P{L}', '', 'g'))
             OR (len(l) >= 5 AND 10 * n_dup_lines > 4 * len(l))
             OR word_chars < 2 * n_words OR 2 * word_chars > 25 * n_words AS rejected FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept FROM v
"""
