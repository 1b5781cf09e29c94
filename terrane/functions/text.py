"""Names: folding of accents, matching form, comparable form, similarity, distinctive words."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.fixed import GENERIC_NAME_WORDS, LEGAL_FORMS, NOT_A_CITY, PLACE_NOISE, WEAK_KEYWORDS


@cache
def _fold_table() -> tuple[str, str]:
    """Composed letters and the base letter of their canonical decomposition, from the Unicode database.

    Every canonical decomposition has one letter and marks, but for Hangul syllables, which have two or three.
    """
    source, target = [], []
    for code in range(0xC0, 0x110000):
        char = chr(code)
        if not unicodedata.decomposition(char) or unicodedata.decomposition(char).startswith("<"):
            continue
        base = [c for c in unicodedata.normalize("NFD", char) if not unicodedata.category(c).startswith("M")]
        if len(base) == 1 and base[0] != char:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


@cache
def _mark_class() -> str:
    """A pattern of all combining marks of the Unicode database; the JVM's own may be of an older version."""
    runs: list[list[int]] = []
    for code in range(0x300, 0x110000):
        if unicodedata.category(chr(code)).startswith("M"):
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]+"


def _hangul(text: Column) -> Column:
    """Hangul syllables as their letters, by the arithmetic of the Unicode standard (syllable blocks of 28 and 588)."""
    char = lambda n: F.decode(F.unhex(F.hex(n)), "UTF-16BE")

    def letters(c: Column) -> Column:
        s = (F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long") - 0xAC00).cast("long")
        lead, vowel, tail = 0x1100 + F.floor(s / 588), 0x1161 + F.floor(s % 588 / 28), 0x11A7 + s % 28
        return F.concat(char(lead), char(vowel), F.when(s % 28 == 0, "").otherwise(char(tail)))

    each = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("^[가-힣]$"), letters(c)).otherwise(c))
    return F.array_join(each, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def strip_marks(text: Column) -> Column:
    """The canonical decomposition of the text without its combining marks; ASCII texts are not touched."""
    source, target = _fold_table()
    plain = F.regexp_replace(F.translate(text, source, target), _mark_class(), "")
    plain = F.when(text.rlike("[가-힣]"), _hangul(plain)).otherwise(plain)
    return F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)


def fold(text: Column) -> Column:
    """Without accents, in lower case, trimmed."""
    return F.regexp_replace(F.lower(strip_marks(text)), r"^\s+|\s+$", "")


def any_of(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def without(words: Column, unwanted: tuple[str, ...]) -> Column:
    """The words that are not in a short fixed list, in order, repeats included."""
    return F.filter(words, lambda w: ~w.isin(*unwanted) & (w != ""))


def matching_name(name: Column) -> Column:
    """Matching form of a business name (T01): trailing legal forms go while a word is left."""
    plain = F.regexp_replace(F.lower(strip_marks(name)), "[.’']", "")
    words = F.filter(F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}&]+", " "), " "), lambda w: w != "")
    last = lambda w: F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), F.lit(1), lambda a, k: F.when(~F.coalesce(F.get(w, k - 1), F.lit("")).isin(*LEGAL_FORMS), k).otherwise(a)
    )
    return F.transform(F.array(words), lambda w: F.array_join(F.slice(w, F.lit(1), last(w)), " ")).getItem(0)


def comparable_name(matching: Column, extra_noise: Column | None = None) -> Column:
    """Words of a matching name without punctuation and place words."""
    words = without(F.split(F.regexp_replace(F.lower(matching), r"[^\p{L}\p{N}]+", " "), " "), PLACE_NOISE)
    return F.array_join(words if extra_noise is None else F.filter(words, lambda w: ~F.array_contains(extra_noise, w)), " ")


def bigrams(comparable: Column) -> Column:
    """Pairs of neighbouring characters of the name without blanks, repeats included."""
    compact = F.regexp_replace(comparable, r"\s+", "")
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    return F.transform(F.array(compact), lambda t: F.filter(pairs(t), lambda g: F.length(g) == 2)).getItem(0)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient over the multisets of bigrams of two comparable names."""

    def of(x: Column, y: Column) -> Column:
        count = lambda grams, g: F.size(F.filter(grams, lambda h: h == g))
        shared = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, g: s + F.least(count(x, g), count(y, g)))
        total = F.size(x) + F.size(y)
        return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * shared / total)

    both = F.array(F.struct(bigrams(a).alias("x"), bigrams(b).alias("y")))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.transform(both, lambda p: of(p["x"], p["y"])).getItem(0))


def distinctive_words(comparable: Column) -> Column:
    return F.filter(F.split(comparable, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*GENERIC_NAME_WORDS))


def share_distinctive_word(a: Column, b: Column) -> Column:
    """Whether two comparable names share an identifying word, or one of five letters inside another."""
    within = lambda x, y: (F.length(x) >= 5) & F.contains(y, x)
    return F.exists(distinctive_words(a), lambda x: F.exists(distinctive_words(b), lambda y: (x == y) | within(x, y) | within(y, x)))


def is_real_city(city: Column, country_code: Column) -> Column:
    """Not empty, unknown, a country name or the country's code."""
    name = fold(city)
    return F.coalesce(~name.isin(*NOT_A_CITY) & (name != F.lower(country_code)), F.lit(False))


def stems(text: Column, unwanted: tuple[str, ...] = ()) -> Column:
    """Distinct folded words of at least three letters, without a final s if longer than four."""
    words = F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)
    kept = F.filter(words, lambda w: ~w.isin(*unwanted)) if unwanted else words
    return F.array_distinct(F.transform(kept, lambda w: F.regexp_replace(w, r"^(.{4,})s$", "$1")))


def keyword_hits(name: Column, keywords: Column) -> Column:
    """How many stems of the keywords, common ones aside, the name has."""
    words = F.array_distinct(F.flatten(F.transform(keywords, lambda k: stems(k, WEAK_KEYWORDS))))
    return F.size(F.array_intersect(stems(name), words))


def like_escaped(text: Column) -> Column:
    r"""Text in which ``\``, ``%`` and ``_`` are literal in a LIKE pattern."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def title_list(text: Column) -> Column:
    """A comma list as trimmed lower-case values."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
