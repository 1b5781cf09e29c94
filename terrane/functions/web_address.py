"""Web addresses as the URL standard parses and writes them, for the schemes http and https.

Written as column expressions: steps of the standard's state machine become regular expressions over the parts
of an address, folds over its labels and segments, and number conversions. Two things differ from the
standard: international host names are put in lower case but not normalised further, so letters
must come composed, and addresses that hold blanks are refused, as ``clean_url`` does before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions.text import let

# Fixed values of the standard: characters that are percent-encoded in paths and in queries, and that no host may have.
PATH_SET = r"""[^\x21\x24-\x3B\x3D\x40-\x5D\x5F\x61-\x7A\x7C\x7E]"""
QUERY_SET = r"""[^\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E]"""
FORBIDDEN_IN_HOST = r"""[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"""
#: Parameters of Punycode: base, least and greatest threshold, skew, damping, first bias, first code point.
BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128

#: An address that the standard leaves as it is: such need no second look.
PLAIN = r"^https?://(?!(?:[^/?#]*\.)?(?:\d+|0x[0-9a-f]*)\.?(?:[/:?#]|$))[a-z0-9-]++(?:\.[a-z0-9-]++)++(?:/(?!\.{1,2}(?:[/?#]|$))[A-Za-z0-9_~!$&'()*+,;=:@.-]*+)*+(?:\?[A-Za-z0-9_~!$&()*+,;=:@./?%-]*+)?$"


def encoded(text: Column, pattern: str) -> Column:
    """The text with each character that the pattern matches as the percent-encoded bytes of its UTF-8 form."""
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    return F.when(text.rlike(pattern), F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(pattern), code(c)).otherwise(c)), "")).otherwise(text)


def without_dots(path: Column) -> Column:
    """The path without segments of one dot and, for segments of two, without what they step back over; dots may be encoded."""
    one, two = "(?i)^(?:\\.|%2e)$", "(?i)^(?:\\.|%2e){2}$"

    def walked(segments: Column) -> Column:
        last = F.size(segments)
        step = lambda done, s: F.when(s["x"].rlike(two), F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), _at_end(s, last))).when(s["x"].rlike(one), F.concat(done, _at_end(s, last))).otherwise(F.concat(done, F.array(s["x"])))
        numbered = F.transform(segments, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.aggregate(numbered, F.array().cast("array<string>"), step)

    segments = F.split(F.substr(path, F.lit(2)), "/")
    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(let(segments, walked), "/"))).otherwise(path)


def _at_end(s: Column, last: Column) -> Column:
    """A step of dots at the end leaves an empty segment, so that the path ends with a slash."""
    return F.when(s["i"] == last - 1, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))


def ipv4(host: Column) -> Column:
    """``(is_number, host)``: whether the last label is a number, and then the address in dotted form, null if it is none.

    Parts are decimal, octal with a leading zero or hexadecimal with 0x; the last one fills the bytes that are left.
    """

    def value(part: Column) -> Column:
        hexa, octal = part.rlike("(?i)^0x[0-9a-f]{0,12}$"), part.rlike("^0[0-7]{1,15}$")
        digits = F.when(hexa, F.conv(F.concat(F.lit("0"), F.substr(part, F.lit(3))), 16, 10)).when(octal, F.conv(part, 8, 10)).when(part.rlike("^(?:0|[1-9][0-9]{0,14})$"), part)
        return digits.cast("long")

    def dotted(p: Column) -> Column:
        n, values = F.size(p), F.transform(p, value)
        room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), n)
        total = lambda v: F.aggregate(F.slice(v, F.lit(1), n - 1), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(256**3).cast("long").alias("unit")), lambda a, x: F.struct((a["sum"] + x * a["unit"]).alias("sum"), F.try_divide(a["unit"], F.lit(256)).cast("long").alias("unit")), lambda a: a["sum"]) + F.element_at(v, -1)
        good = lambda v: (n <= 4) & ~F.exists(v, lambda x: x.isNull()) & ~F.exists(F.slice(v, F.lit(1), n - 1), lambda x: x > 255) & (F.element_at(v, -1) < room)
        text = lambda v: F.array_join(F.transform(F.array(F.lit(24), F.lit(16), F.lit(8), F.lit(0)), lambda s: (F.floor(v / F.pow(F.lit(2), s)) % 256).cast("long").cast("string")), ".")
        return let(values, lambda v: F.when(F.when(n <= 4, good(v)).otherwise(False), let(total(v), text)))

    labels = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    is_number = F.element_at(labels, -1).rlike(r"(?i)^(?:\d+|0x[0-9a-f]*)$")
    return F.struct(is_number.alias("is_number"), F.when(is_number, let(labels, dotted)).alias("host"))


def punycode(label: Column) -> Column:
    """A label with characters beyond ASCII in its ASCII form, with ``xn--`` before it."""
    digit = lambda d: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), d.cast("int") + 1, F.lit(1))
    steps = F.sequence(F.lit(1), F.lit(12))

    def number(q: Column, bias: Column) -> Column:
        """A delta as a number of variable length."""

        def next_digit(a: Column, i: Column) -> Column:
            t = F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), i * BASE - bias)).cast("long")
            low = t + (a["q"] - t) % (BASE - t)
            more = F.struct(F.floor((a["q"] - t) / (BASE - t)).cast("long").alias("q"), F.concat(a["out"], digit(low)).alias("out"), F.lit(False).alias("end"))
            return F.when(a["end"], a).when(a["q"] < t, F.struct(a["q"].alias("q"), F.concat(a["out"], digit(a["q"])).alias("out"), F.lit(True).alias("end"))).otherwise(more)

        return F.aggregate(steps, F.struct(q.alias("q"), F.lit("").alias("out"), F.lit(False).alias("end")), next_digit, lambda a: a["out"])

    def adapted(delta: Column, points: Column, first: Column) -> Column:
        start = F.when(first, F.floor(delta / DAMP)).otherwise(F.floor(delta / 2)).cast("long")
        begin = F.struct((start + F.floor(start / points).cast("long")).alias("d"), F.lit(0).cast("long").alias("k"))
        limit = (BASE - T_MIN) * T_MAX // 2
        step = lambda a, _: F.when(a["d"] > limit, F.struct(F.floor(a["d"] / (BASE - T_MIN)).cast("long").alias("d"), (a["k"] + BASE).alias("k"))).otherwise(a)
        return F.aggregate(steps, begin, step, lambda a: (a["k"] + F.floor((BASE - T_MIN + 1) * a["d"] / (a["d"] + SKEW))).cast("long"))

    def of(chars: Column) -> Column:
        points = F.transform(chars, lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))

        def written(cps: Column) -> Column:
            basic = F.filter(chars, lambda c: c.rlike(r"^[\x00-\x7F]$"))
            wide = F.array_sort(F.array_distinct(F.filter(cps, lambda p: p >= FIRST)))
            n_basic = F.size(basic).cast("long")
            begin = F.struct(F.lit(FIRST).cast("long").alias("n"), F.lit(0).cast("long").alias("delta"), F.lit(BIAS).cast("long").alias("bias"), n_basic.alias("h"), F.lit("").alias("out"))

            def round_of(a: Column, m: Column) -> Column:
                at = F.struct(m.alias("n"), (a["delta"] + (m - a["n"]) * (a["h"] + 1)).alias("delta"), a["bias"].alias("bias"), a["h"].alias("h"), a["out"].alias("out"))

                def look(b: Column, p: Column) -> Column:
                    hit = F.struct(m.alias("n"), F.lit(0).cast("long").alias("delta"), adapted(b["delta"], b["h"] + 1, b["h"] == n_basic).alias("bias"), (b["h"] + 1).alias("h"), F.concat(b["out"], number(b["delta"], b["bias"])).alias("out"))
                    less = F.struct(b["n"].alias("n"), (b["delta"] + 1).alias("delta"), b["bias"].alias("bias"), b["h"].alias("h"), b["out"].alias("out"))
                    return F.when(p == m, hit).when(p < m, less).otherwise(b)

                done = lambda b: F.struct((b["n"] + 1).alias("n"), (b["delta"] + 1).alias("delta"), b["bias"].alias("bias"), b["h"].alias("h"), b["out"].alias("out"))
                return F.aggregate(cps, at, look, done)

            out = F.aggregate(wide, begin, round_of, lambda a: a["out"])
            return F.concat(F.lit("xn--"), F.array_join(basic, ""), F.when(n_basic > 0, "-").otherwise(""), out)

        return let(points, written)

    return F.when(label.rlike(r"[^\x00-\x7F]"), let(F.split(label, ""), of)).otherwise(label)


def host_text(raw: Column) -> Column:
    """A host as the standard writes it, or null: percent-decoded, in lower case, in ASCII; numbers as an IPv4 address."""
    decoded = F.when(F.contains(raw, F.lit("%")), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    # Full stops of other scripts count as dots; soft hyphens and joiners as nothing.
    low = F.regexp_replace(F.regexp_replace(F.lower(decoded), "[。．｡]", "."), "[\\u00AD\\u200B-\\u200D\\u2060\\uFEFF]", "")
    plain = F.when(low.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(low, r"\."), punycode), ".")).otherwise(low)
    written = lambda h: let(ipv4(h), lambda v: F.when(v["is_number"], v["host"]).otherwise(h))
    return let(plain, lambda h: F.when((h != "") & ~h.rlike(FORBIDDEN_IN_HOST), written(h)))


def parsed(value: Column) -> Column:
    """``(scheme, host, port, path, query)`` of an address with a scheme, all as the standard writes them; null if it is none.

    ``port`` is empty for the scheme's own; ``query`` is null without one. Credentials and fragment are left out.
    """

    def parts(v: Column) -> Column:
        slashed = F.concat(F.replace(F.regexp_extract(v, r"(?s)^[^?#]*", 0), F.lit("\\"), F.lit("/")), F.regexp_extract(v, r"(?s)^[^?#]*(.*)$", 1))
        part = lambda u, k: F.regexp_extract(u, r"(?is)^(https?):/*(?:([^/?#]*)@)?([^/?#:@]*)(:[^/?#]*)?([^?#]*)(\?[^#]*)?(?:#.*)?$", k)
        return let(slashed, lambda u: F.struct(F.lower(part(u, 1)).alias("scheme"), part(u, 3).alias("host"), part(u, 4).alias("port"), part(u, 5).alias("path"), part(u, 6).alias("query")))

    def written(p: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(p["port"], "^:", ""), "^0+(?=[0-9])", "")
        good = p["port"].rlike("^(?::[0-9]*)?$") & (F.coalesce(F.nullif(digits, F.lit("")), F.lit("0")).try_cast("long") <= 65535)
        own = F.when(p["scheme"] == "http", "80").otherwise("443")
        path = encoded(without_dots(F.when(p["path"] == "", "/").otherwise(p["path"])), PATH_SET)
        query = F.when(p["query"] != "", encoded(F.substr(p["query"], F.lit(2)), QUERY_SET))
        port = F.when(digits == own, F.lit("")).otherwise(digits)
        made = lambda h: F.when(h.isNotNull() & (p["scheme"] != "") & F.coalesce(good, F.lit(False)), F.struct(p["scheme"].alias("scheme"), h.alias("host"), port.alias("port"), path.alias("path"), query.alias("query")))
        return let(host_text(p["host"]), made)

    return let(parts(value), written)
