r"""Line deduplication by a log-template tree of fixed depth (DataFrame functions only).

A line's tokens are its words; a word with a digit is variable from the start and counts as
``<*>``. A path of the tree is the number of tokens and then up to three neighbouring tokens, which are
the leading ones, the trailing ones or one of two runs between them, so that a line whose fields lie in at
most three of these runs still meets its like. A leaf holds the distinct lines of a path. In leaves
of several lines positions are generalised: a token is constant if other lines of the leaf have it
in its place, and of these at least two thirds as many as have the line's middling token in its place; all others are
fields and become ``<*>``, those of few values included. A line counts in its two largest leaves. Lines of which at least two thirds of the
tokens stay belong to the template of what stays.

A template recurs by the number of its documents: whole lines from two documents on, generalised
ones from three, and short lines ("The end."), which meet by chance, from ten. Lines of a
recurring template go from all documents but the one with the smallest id, so what they share is
left once. That document is reported beside each dropped line.

Only hashes and ids are shuffled to find the templates; the tokens of a line are needed again in
leaves of several lines only. The texts move once, to be joined with their dropped lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.expressions import SPACE_RUN, bind, fresh, named, text_of, words_of
from terrane.session import checkpointed

#: Runs of tokens that begin a path, evenly spread: the most of them, for lines of so many tokens; fewer in shorter lines.
RUNS = ((8, 4), (6, 3), (0, 2))
#: Tokens of a run, for lines of so many tokens.
DEPTH = ((12, 3), (4, 2), (0, 1))
#: Bits of the table that tells which lines' tokens are needed.
BITS = 1 << 27
LEAVES = tuple(f"leaf{i}" for i in range(4))


@dataclass(frozen=True)
class Rules:
    """Documents from which a template recurs, and the characters in tokens below which a line is short."""

    whole: int = 2
    generalised: int = 3
    short: int = 10
    short_chars: int = 40


def tokens(line: Column) -> Column:
    """The tokens of a line, those with digits as ``<*>``."""
    digit = lambda x: x.rlike("[0-9]")
    return F.when(digit(line), F.transform(words_of(line), lambda w: F.when(digit(w), "<*>").otherwise(w))).otherwise(words_of(line))


def by_size(n: Column, steps: tuple[tuple[int, int], ...]) -> Column:
    """The value of the first step that ``n`` reaches."""
    chain = F
    for least, value in steps[:-1]:
        chain = chain.when(n >= least, F.lit(value))
    return chain.otherwise(F.lit(steps[-1][1]))


def line_key(line: Column, short_chars: int) -> Column:
    """Hashes of the whole line and its paths, and whether it is long; null for a line without tokens."""

    def of(t: Column) -> Column:
        n = F.size(t)
        k, runs = by_size(n, DEPTH), by_size(n, RUNS)

        def path(i: int) -> Column:
            first = F.floor(F.lit(i) * (n - k) / (runs - 1)).cast("int") + 1
            return F.when((n > 2) & (runs > i), F.xxhash64(F.lit(i), n, F.slice(t, first, k)))

        key = F.struct(
            F.xxhash64(n, t).alias("whole"),
            *[path(i).alias(c) for i, c in enumerate(LEAVES)],
            (F.length(F.array_join(t, "")) >= short_chars).alias("long"),
        )
        return F.when(n > 0, key)

    return bind(tokens(line), of)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_keys(docs: DataFrame, rules: Rules, id_col: str, text_col: str) -> DataFrame:
    """``(doc, line, whole, leaf0 .. leaf3, long)`` of all lines with tokens in documents with an id."""
    keys = F.transform(_lines(text_of(named(text_col))), lambda line: line_key(line, rules.short_chars))
    # Counting and dropping both need the hashes; they are small beside the texts and are made once.
    hashed = checkpointed(docs.select(named(id_col).cast("long").alias("doc"), keys.alias("keys")).where("doc IS NOT NULL"))
    return hashed.select("doc", F.posexplode("keys").alias("line", "key")).where("key IS NOT NULL").select("doc", "line", "key.*")


def distinct_lines(keys: DataFrame) -> DataFrame:
    """Each distinct line with the number of its documents, the smallest of them and its place there.

    Summed up in the map tasks over rows that are distinct by document first, so a line in a third
    of all documents does not meet in one task.
    """
    by_doc = keys.groupBy("whole", "doc", *LEAVES, "long").agg(F.min("line").alias("line"))
    first = F.min(F.struct("doc", "line")).alias("first")
    return by_doc.groupBy("whole", *LEAVES, "long").agg(F.count("*").alias("n_docs"), first).withColumn("first_doc", F.col("first.doc"))


def words_at(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(w, words)``: hashes of the tokens of the lines at the places ``first`` of ``members``, by the hash of the whole line.

    A table of bits, at most BITS / 64 rows, says in the map tasks which places are asked for (and a few
    others), so that no text is moved to find them.
    """
    bit = lambda doc, line: F.pmod(F.xxhash64(doc, line), F.lit(BITS))
    at = bit(F.col("first.doc"), F.col("first.line"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))
    asked = members.select(at.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("cell")).agg(F.bit_or(one).alias("bits"))
    every = docs.select(named(id_col).cast("long").alias("doc"), F.posexplode(_lines(text_of(named(text_col)))).alias("line", "text")).withColumn("b", bit(F.col("doc"), F.col("line")))
    hit = every.join(F.broadcast(asked), F.floor(F.col("b") / 64) == F.col("cell")).where(F.call_function("shiftright", F.col("bits"), (F.col("b") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    # The hash of a line is never null, and must not look so: a join on it would ask every line for its tokens, to tell.
    each = hit.select(tokens(F.col("text")).alias("t")).select(F.xxhash64(F.size("t"), "t").alias("w"), F.transform("t", lambda y: F.xxhash64(y)).alias("words"))
    return each.groupBy("w").agg(F.first("words").alias("words"))


def generalise(docs: DataFrame, distinct: DataFrame, rules: Rules, id_col: str, text_col: str) -> DataFrame:
    """``(whole, template, long)``: the generalised templates of the lines in leaves of several lines.

    A line counts in its two largest leaves. Positions are counted by leaf, place and token with map-side
    sums; a template is an order-free hash of the tokens that stay with their places, so no leaf is ever collected.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("leaf")) for i, c in enumerate(LEAVES)])).alias("x")
    paths = distinct.select("whole", "long", "n_docs", "first", each).select("whole", "long", "n_docs", "first", "x.i", "x.leaf").where("leaf IS NOT NULL")
    mixed = paths.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("n_docs").alias("d")).where((F.col("lines") > 1) & (F.col("d") >= rules.generalised))
    inside = paths.join(mixed.select(F.col("leaf").alias("m"), "lines"), F.col("leaf") == F.col("m"))
    largest = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("lines")).alias("lines"), "i", "leaf"))), 1, 2)
    members = checkpointed(inside.groupBy("whole", "long", "first").agg(F.transform(largest, lambda x: x["leaf"]).alias("leaves")))
    # The tokens come from the first place of each line.
    words = words_at(docs, members, id_col, text_col)
    placed = checkpointed(members.join(words, F.col("whole") == F.col("w")).select("whole", "long", F.explode("leaves").alias("leaf"), "words"))
    # A token in its place of a leaf is one number, which is all that is dealt out.
    spread = placed.select("leaf", "whole", F.posexplode("words").alias("place", "token")).select("leaf", "whole", F.xxhash64("leaf", "place", "token").alias("mark"))
    # Checkpointed, so that adaptive execution can split the join at a token that very many lines have in one place.
    kept = checkpointed(spread.groupBy(F.col("mark").alias("m")).agg(F.count("*").alias("lines")).where("lines > 1"))
    found = spread.join(kept, F.col("mark") == F.col("m")).groupBy("leaf", "whole").agg(F.sort_array(F.collect_list(F.struct("lines", "mark"))).alias("x"))
    sizes = placed.select(F.col("leaf").alias("l"), F.col("whole").alias("w"), "long", F.size("words").alias("n"))
    shape = found.join(sizes, (F.col("leaf") == F.col("l")) & (F.col("whole") == F.col("w"))).where(3 * F.size("x") >= 2 * F.col("n"))

    def constant(x: Column) -> Column:
        # Tokens that no other line has in their place are not in x, and rank below all that are.
        middling = F.get(x, (F.floor((F.col("n") - 1) / 2) - (F.col("n") - F.size(x))).cast("int"))["lines"]
        return bind(middling, lambda m: F.filter(x, lambda e: 3 * e["lines"] >= 2 * m))

    shape = shape.select("leaf", "whole", "long", "n", constant(F.col("x")).alias("x")).where((F.size("x") < F.col("n")) & (3 * F.size("x") >= 2 * F.col("n")))
    mixed_marks = F.aggregate("x", F.lit(0).cast("long"), lambda a, e: a.bitwiseXOR(e["mark"]))
    return shape.select("whole", F.xxhash64("leaf", F.size("x"), mixed_marks).alias("template"), "long")


def recurring(docs: DataFrame, keys: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(whole, kept_in)``: lines of recurring templates with the smallest document that keeps one of them."""
    distinct = checkpointed(distinct_lines(keys))
    often = lambda most: F.col("n_docs") >= F.when(F.col("long"), F.lit(most)).otherwise(F.lit(max(most, rules.short)))
    whole = distinct.where(often(rules.whole)).select("whole", F.col("first_doc").alias("kept_in"))
    shapes = checkpointed(generalise(docs, distinct, rules, id_col, text_col))
    inside = keys.select("doc", F.col("whole").alias("w")).join(shapes, F.col("w") == F.col("whole")).groupBy("template", "doc").agg(F.min("long").alias("long"))
    counted = inside.groupBy("template").agg(F.count("*").alias("n_docs"), F.min("doc").alias("kept_in"), F.min("long").alias("long")).where(often(rules.generalised))
    by_shape = shapes.join(counted.select(F.col("template").alias("t"), "kept_in"), F.col("template") == F.col("t")).select("whole", "kept_in")
    # Checkpointed, so that adaptive execution sees a plain shuffle beside the lines and can split a common one.
    return checkpointed(whole.union(by_shape).groupBy("whole").agg(F.min("kept_in").alias("kept_in")))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``(doc, gone)``: sorted ``(line, kept_in)`` of the lines to drop, numbered from 0; only documents that have any."""
    keys = line_keys(docs, rules, id_col, text_col)
    often = recurring(docs, keys, rules, id_col, text_col).select(F.col("whole").alias("often"), "kept_in")
    hits = keys.select("doc", "line", "whole").join(often, F.col("whole") == F.col("often")).where("doc > kept_in")
    return hits.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("line", "kept_in"))).alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    r"""All rows and columns of ``docs``, with recurring lines dropped, and one column more.

    ``__gone`` (with further underscores if ``docs`` has that name) lists ``(line, kept_in)``: the
    numbers, from 0, of the dropped ``\n``-separated lines and the document that keeps a line of the
    template. The text is unchanged, null included, where nothing is dropped. Rows with the same id
    are one document: they keep or lose a line alike. Of documents with a template the smallest id
    keeps its lines, so there are no ties. Rows without an id keep all lines. Empty tables give an
    empty result.
    """
    doc, gone = fresh(docs, "__doc", "__gone")
    found = dropped_lines(docs, id_col, text_col, rules).toDF(doc, gone)
    joined = docs.join(found, named(id_col).cast("long") == F.col(doc), "left")

    def kept(x: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.transform(gone, lambda g: g["line"]))
        return F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")

    text = F.when(F.col(gone).isNull(), named(text_col)).otherwise(bind(_lines(named(text_col)), kept))
    none = F.array().cast("array<struct<line:int,kept_in:bigint>>")
    return joined.select(*[named(c) if c != text_col else text.alias(text_col) for c in docs.columns], F.coalesce(gone, none).alias(gone))


def without_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` without recurring lines, with the same columns; rows of which no word is left go.

    Rows that lose no line stay as they are, those without a word included. ``length_col``, where the
    table has it, counts the text that is left.
    """
    (gone,) = fresh(docs, "__gone")
    done = dedup(docs, id_col, text_col, rules)
    whole = F.size(gone) == 0
    kept = done.where(whole | named(text_col).rlike(r"[^\x20\x09-\x0D]"))
    left = F.length(text_of(named(text_col)))
    return kept.select(*[F.when(whole, named(c)).otherwise(left.cast(t)).alias(c) if c == length_col else named(c) for c, t in docs.dtypes])


def digest(docs: DataFrame) -> DataFrame:
    """Lines left, numbers of the dropped ones and who keeps them, length and checksum of the text that is left."""
    done = dedup(docs.select("doc_id", "text"))
    text = text_of("text")
    listed = lambda field: F.array_join(F.transform("__gone", lambda g: g[field].cast("string")), ",")
    left = F.when(text == "", F.lit(0)).otherwise(F.size(_lines(text)))
    return done.select(
        "doc_id",
        left.cast("long").alias("n_left"),
        F.size("__gone").cast("long").alias("n_dropped"),
        listed("line").alias("dropped"),
        listed("kept_in").alias("kept_in"),
        F.length(text).cast("long").alias("n_chars"),
        F.sha2(text, 256).alias("text_sha256"),
    )


def _case(steps: tuple[tuple[int, int], ...]) -> str:
    return "CASE " + " ".join(f"WHEN len(w) >= {least} THEN {value}" for least, value in steps) + " END"


_WORD = r"[^\x20\x09-\x0D]*"
_RULES = Rules()
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, i - 1 AS line, list_filter(regexp_split_to_array(regexp_replace(l[i], '{_WORD}[0-9]{_WORD}', '<*>', 'g'), '{SPACE_RUN}'), lambda w: w <> '') AS w
      FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM d WHERE doc_id IS NOT NULL)),
y AS (SELECT doc_id, line, w, len(w) AS n, {_case(DEPTH)} AS k, {_case(RUNS)} AS runs, array_to_string(w, ' ') AS whole, length(array_to_string(w, '')) >= {_RULES.short_chars} AS long_ FROM x WHERE len(w) > 0),
u AS (SELECT whole, any_value(w) AS w, any_value(n) AS n, any_value(k) AS k, any_value(runs) AS runs, any_value(long_) AS long_, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM y GROUP BY whole),
z AS (SELECT *, i * (n - k) // (runs - 1) AS at_ FROM (SELECT *, unnest(generate_series(0, runs - 1)) AS i FROM u WHERE n > 2)),
p AS (SELECT *, i || ' ' || n || ' ' || array_to_string(w[at_ + 1:at_ + k], ' ') AS leaf FROM z),
m AS (SELECT leaf, count(*) AS lines FROM p GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= {_RULES.generalised}),
a AS (SELECT leaf, whole, long_, n, unnest(generate_series(1, n)) AS place, unnest(w) AS token FROM (SELECT * FROM p JOIN m USING (leaf) QUALIFY row_number() OVER (PARTITION BY whole ORDER BY lines DESC, i) <= 2)),
s AS (SELECT leaf, place, token, count(*) AS c FROM a GROUP BY ALL HAVING count(*) > 1),
b AS (SELECT leaf, whole, list(c ORDER BY c) AS cs FROM a JOIN s USING (leaf, place, token) GROUP BY leaf, whole, n HAVING 3 * count(*) >= 2 * n),
g AS (SELECT leaf, whole, long_, leaf || ' | ' || string_agg(place || ' ' || token, ' ' ORDER BY place) AS template FROM a JOIN s USING (leaf, place, token) JOIN b USING (leaf, whole)
      WHERE 3 * c >= 2 * cs[(n - 1) // 2 - (n - len(cs)) + 1] GROUP BY leaf, whole, long_, n HAVING count(*) < n AND 3 * count(*) >= 2 * n),
c AS (SELECT template, min(doc_id) AS kept_in FROM g JOIN y USING (whole) GROUP BY template HAVING count(DISTINCT doc_id) >= CASE WHEN bool_and(g.long_) THEN {_RULES.generalised} ELSE {max(_RULES.generalised, _RULES.short)} END),
r AS (SELECT whole, min(kept_in) AS kept_in FROM (SELECT whole, first_doc AS kept_in FROM u WHERE docs >= CASE WHEN long_ THEN {_RULES.whole} ELSE {max(_RULES.whole, _RULES.short)} END UNION ALL SELECT whole, kept_in FROM g JOIN c USING (template)) GROUP BY whole),
h AS (SELECT DISTINCT doc_id, line, kept_in FROM y JOIN r USING (whole) WHERE doc_id > kept_in),
e AS (SELECT doc_id, list(line ORDER BY line, kept_in) AS gone, list(kept_in ORDER BY line, kept_in) AS keepers FROM h GROUP BY doc_id),
o AS (SELECT doc_id, coalesce(gone, []) AS gone, coalesce(keepers, []) AS keepers, CASE WHEN gone IS NULL THEN t ELSE array_to_string([l[i + 1] for i in range(len(l)) if NOT list_contains(gone, i)], chr(10)) END AS t FROM d LEFT JOIN e USING (doc_id))
SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS BIGINT) AS n_left, CAST(len(gone) AS BIGINT) AS n_dropped, array_to_string(gone, ',') AS dropped, array_to_string(keepers, ',') AS kept_in, length(t) AS n_chars, sha256(t) AS text_sha256 FROM o
"""
