"""Secret scans: positioned candidates and corpus-wide ownership frequency (DataFrame functions only).

Regular expressions give candidates with their code-point spans; each secret is reduced to a
hash, and over the whole corpus the distinct repositories and owners of a hash are counted. A
value that many owners share is a copied example; one that stays with a single owner looks
live. Base kinds (assign, access, hex) are reported whatever their class; the further kinds add
spans only for values that look live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.expressions import bind, text_of
from terrane.session import checkpointed


@dataclass(frozen=True)
class Kind:
    """A kind of secret: matches of ``pattern`` whose group ``group``, the value, has at least ``least`` characters.

    Matches in which ``unless`` is found don't count; ``mixed`` asks for a letter, a digit and ten
    different characters in the value, as random ones have. A text without ``hint`` (a plain string or,
    with brackets, a pattern) has no match, which is found out faster.
    """

    name: str
    pattern: str
    group: int
    least: int
    base: bool
    unless: str = ""
    mixed: bool = False
    hint: str = ""


#: Kinds in the order in which spans with the same start are listed.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Kind("hex", r"[0-9a-f]+", 0, 24, True),
    Kind("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, False),
    Kind("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 40, False, hint="eyJ"),
    Kind("url_login", r"(?<![a-z0-9+])[a-z][a-z0-9+]*+://[^\s/:@]++:([^\s/:@]++)@", 1, 6, False, hint="://"),
    Kind("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END", 0, 64, False),
    Kind("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]+)", 1, 16, False, mixed=True),
    # A quoted value of any other name: what tells it from a setting is that it looks random and that one owner has it.
    Kind("quoted", r"""(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++["']?\x20*[:=]\x20*["']([A-Za-z0-9+/_.=-]+)["']""", 1, 20, False, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", True, """["'][A-Za-z0-9+/_.=-]{20,}["']"""),
)
DIFFERENT = 10
#: A value of at least so many owners in so many repositories is a copied example; where a table has no
#: column of repositories, each document counts as one.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 10


def running_sums(steps: Column, chunk: int = 256) -> Column:
    """The sums of the first one, two, … entries of an array of bigints.

    An array can only grow by copying, so it is summed in chunks, and the chunks' totals on their
    own: a text with a million matches costs some hundred copies an entry, not a million.
    """
    grow = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["sums"], F.array(a["at"] + x)).alias("sums"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("sums"))
    sums = lambda places, value: F.aggregate(places, start, lambda a, i: grow(a, value(i)), lambda a: a["sums"])
    n = F.size(steps)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(chunk)), lambda c: sums(F.sequence(c, F.least(c + chunk, n) - 1), lambda i: F.get(steps, i)))

    def joined(found: Column) -> Column:
        totals = F.transform(found, lambda x: F.get(x, F.size(x) - 1))
        before = bind(totals, lambda t: sums(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i)))
        return bind(before, lambda ends: F.flatten(F.transform(found, lambda x, k: F.transform(x, lambda v: v + F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(ends, k - 1))))))

    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(bind(parts, joined))


def _looks_random(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT)


def _matches(text: Column, kind: Kind, order: int) -> Column:
    """All matches of one kind with their values and the lengths of the text before each; null without any.

    Splitting at the pattern and extracting it walk the same matches, so the lengths of the parts
    in between give the positions. Runs of hexadecimal digits are everywhere in prose; as a run is
    matched whole, only those that are long enough need to be matched at all.
    """
    pattern = f"[0-9a-f]{{{kind.least},}}" if kind.name == "hex" else kind.pattern

    def of(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda p: F.length(p)), F.lit(1), F.size(found))
        values = found if kind.group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(kind.group))
        return F.struct(F.lit(order).alias("kind"), found.alias("found"), values.alias("values"), gaps.alias("gaps"))

    hinted = F.lit(True) if not kind.hint else text.rlike(kind.hint) if "[" in kind.hint else text.contains(kind.hint)
    return F.when(hinted & text.rlike(pattern), bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of))


def _counts(kinds: tuple[Kind, ...], kind: Column, match: Column, value: Column) -> Column:
    """Whether a match is a candidate of its kind."""
    chain = F
    for k, x in enumerate(kinds):
        test = F.length(value) >= x.least
        if x.unless:
            test &= ~match.rlike(x.unless)
        if x.mixed:
            test &= _looks_random(value)
        chain = chain.when(kind == k, test)
    return chain.otherwise(F.lit(False))


def candidates(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """All candidates ``(start, kind, end, value)`` of a text, sorted by start and kind."""

    def placed(x: Column) -> Column:
        steps = F.zip_with(x["gaps"], x["found"], lambda gap, m: (gap + F.length(m)).cast("long"))
        rows = F.arrays_zip(bind(steps, lambda s: running_sums(s)).alias("end"), x["found"].alias("m"), x["values"].alias("v"))
        good = F.filter(rows, lambda r: _counts(kinds, x["kind"], r["m"], r["v"]))
        return F.transform(good, lambda r: F.struct((r["end"] - F.length(r["m"])).cast("long").alias("start"), x["kind"].alias("kind"), r["end"].alias("end"), r["v"].alias("value")))

    found = F.array_compact(F.array(*[_matches(text, kind, k) for k, kind in enumerate(kinds)]))
    return F.sort_array(F.flatten(F.transform(found, placed)))


def _names(kinds: tuple[Kind, ...]) -> Column:
    return F.array(*[F.lit(kind.name) for kind in kinds])


def _listed(spans: Column, kinds: tuple[Kind, ...]) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(_names(kinds), s["kind"]), s["start"], s["end"])), ",")


def ownership(found: DataFrame) -> DataFrame:
    """``(hash, n_repositories, n_owners, looks_live)`` of each secret over the corpus.

    ``found`` has ``(hash, repository, owner)`` rows. Distinct owners are counted over rows that
    are already distinct by owner, so a value in a third of all documents is summed in its map
    tasks and never meets in one.
    """
    by_repository = found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    counted = by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))
    return counted.withColumn("looks_live", ~((F.col("n_owners") >= EXAMPLE_OWNERS) & (F.col("n_repositories") >= EXAMPLE_REPOSITORIES)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row for each row of ``docs``: counts of base kinds, base spans, and all spans with their class.

    ``spans`` is an array of ``(start, kind, end, value_hash, n_repositories, n_owners, looks_live)``
    by start and kind. Owners default to the column ``source`` and repositories to the document;
    null counts as an owner of its own. Null or empty text has no spans; repeated rows are scanned
    one by one (and count as one repository); other columns do not matter; an empty table gives
    an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository_col or id_col).cast("string"), F.lit("")).alias("repository"),
        candidates(text_of(text_col), kinds).alias("found"),
    )
    hashed = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    # The values themselves go no further than this step.
    kept = checkpointed(rows.select(F.expr("uuid()").alias("row"), "doc_id", "owner", "repository", hashed.alias("found")))
    single = kept.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("s"))
    classes = ownership(single.select(F.col("s.hash").alias("hash"), "repository", "owner")).withColumnRenamed("hash", "class_hash")
    joined = single.join(classes, F.col("s.hash") == F.col("class_hash"))
    span = F.struct("s.start", "s.kind", "s.end", F.col("s.hash").alias("value_hash"), "n_repositories", "n_owners", "looks_live")
    is_base = F.array(*[F.lit(kind.base) for kind in kinds])
    spans = joined.where(F.get(is_base, F.col("s.kind")) | F.col("looks_live")).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans")).withColumnRenamed("row", "span_row")
    return kept.join(spans, kept.row == spans.span_row, "left").select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def digest(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts, the checksum of base spans, all spans as text, and how many values look live."""
    scanned = scan(docs, kinds=kinds)
    order = {kind.name: k for k, kind in enumerate(kinds)}
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == order[name])).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([k for k, kind in enumerate(kinds) if kind.base]))
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_listed(base, kinds), 256).alias("base_sha256"),
        _listed(F.col("spans"), kinds).alias("spans"),
        F.size(F.filter("spans", lambda s: s["looks_live"])).cast("long").alias("n_live"),
    )


#: The same patterns for a matcher without look-behind: what must not stand before is matched, too.
_DUCK = {
    "hex": "([0-9a-f]{24,})",
    "access": "(AKIA[A-Z0-9]+)",
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "code_host": "(gh[pousr]_[A-Za-z0-9]+)",
    "web_token": r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)",
    "url_login": r"(?:^|[^a-z0-9+])([a-z][a-z0-9+]*://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/:@]+)@)",
    "private_key": "(-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END)",
    "bearer": r"((?i:bearer)\x20+([A-Za-z0-9+/_.=-]+))",
    "quoted": r"""(?:^|[^A-Za-z0-9_-])([A-Za-z0-9_-]+["']?\x20*[:=]\x20*["']([A-Za-z0-9+/_.=-]+)["'])""",
}


def _duck_kind(order: int, kind: Kind) -> str:
    """Rows of one kind: the whole match, the span's text and the value of each match, numbered."""
    pattern = _DUCK[kind.name].replace("'", "''")
    text = {"assign": 0}.get(kind.name, 1)
    value = {"url_login": 2, "bearer": 2, "quoted": 2}.get(kind.name, 1)
    unless = f"NOT regexp_matches(whole, '{kind.unless.replace("'", "''")}')" if kind.unless else "true"
    mixed = f"regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {DIFFERENT}" if kind.mixed else "true"
    return f"""SELECT *, {unless} AND {mixed} AS good FROM (SELECT doc_id, row_, {order} AS kind, '{kind.name}' AS name, {kind.least} AS least, {str(kind.base).lower()} AS base, unnest(generate_series(1, len(m))) AS i, unnest(m) AS whole, unnest(s) AS span, unnest(v) AS value, unnest(p[:len(m)]) AS gap
    FROM (SELECT doc_id, row_, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {text}) AS s, regexp_extract_all(t, '{pattern}', {value}) AS v, regexp_split_to_array(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}')))"""


ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(_duck_kind(k, kind) for k, kind in enumerate(KINDS))}),
e AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY row_, kind ORDER BY i) AS e FROM k),
c AS (SELECT row_, doc_id, kind, name, base, CAST(e - length(span) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, sha256(value) AS h FROM e WHERE length(value) >= least AND good),
o AS (SELECT h, NOT (count(DISTINCT owner) >= {EXAMPLE_OWNERS} AND count(DISTINCT (owner, c.doc_id)) >= {EXAMPLE_REPOSITORIES}) AS live FROM c JOIN d USING (row_) GROUP BY h),
g AS (SELECT row_, count(*) FILTER (WHERE name = 'assign') AS n_assign, count(*) FILTER (WHERE name = 'access') AS n_access, count(*) FILTER (WHERE name = 'hex') AS n_hex,
      string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE base) AS b, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE base OR live) AS a, count(*) FILTER (WHERE live) AS n_live FROM c JOIN o USING (h) GROUP BY row_)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN g USING (row_)
"""
