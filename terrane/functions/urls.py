"""URLs: cleaning, hosts, platforms, own domains, links, signals of selling online."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import fixed, web_address
from terrane.functions.text import fold, let


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains, longest first."""
    parts = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))
    return F.transform(F.array(F.split(host, r"\.")), parts).getItem(0)


def is_in_domains(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether the host is one of a short list of domains or below one."""
    return F.exists(host_suffixes(host), lambda s: s.isin(*domains))


def _plain(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"\.$", "")


def platform_domain(host: Column) -> Column:
    """The platform's own domain above a host, or null."""
    known = [h for hosts in fixed.PLATFORM_HOSTS.values() for h in hosts]
    return F.get(F.filter(host_suffixes(_plain(host)), lambda s: s.isin(*known)), F.lit(0))


def platform_kind(host: Column) -> Column:
    """Kind of platform of a host: by domain, else by brand; null for an ordinary site."""

    def kind_of(known: Column) -> Column:
        chain = F
        for kind, hosts in fixed.PLATFORM_HOSTS.items():
            chain = chain.when(known["domain"].isin(*hosts), F.lit(kind))
        for kind in fixed.PLATFORM_HOSTS:
            chain = chain.when(known["brand"].isin(*[b for b, k in fixed.PLATFORM_BRANDS.items() if k == kind]), F.lit(kind))
        return chain.otherwise(F.lit(None).cast("string"))

    brand = rf"(?:^|\.)({'|'.join(fixed.PLATFORM_BRANDS)})\.[a-z]{{2,3}}(?:\.[a-z]{{2}})?$"
    return let(_plain(host), lambda h: let(F.struct(platform_domain(h).alias("domain"), F.regexp_extract(h, brand, 1).alias("brand")), kind_of))


def host_of(url: Column) -> Column:
    """The host of a cleaned URL."""
    return F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)


def _asked(query: Column) -> Column:
    """The query without tracking parameters; written anew as a form if it had one, else as it is, empty without a name."""
    name = lambda q: F.lower(F.coalesce(F.try_url_decode(F.substring_index(q, "=", 1)), F.substring_index(q, "=", 1)))
    tracks = lambda q: name(q).isin(*fixed.TRACKING_NAMES) | name(q).rlike("^(" + "|".join(fixed.TRACKING_PREFIXES) + ")")
    anew = lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x))
    form = lambda q: F.concat(anew(F.substring_index(q, "=", 1)), F.lit("="), anew(F.when(F.contains(q, F.lit("=")), F.substr(q, F.instr(q, "=") + 1)).otherwise("")))
    pairs = F.filter(F.split(query, "&"), lambda q: q != "")
    left = lambda ps: F.transform(F.filter(ps, lambda q: ~tracks(q)), form)
    return let(pairs, lambda ps: F.when(F.exists(ps, tracks), F.array_join(left(ps), "&")).when(F.size(ps) == 0, F.lit("")).otherwise(query))


def clean_url(raw: Column) -> Column:
    """A usable web address without tracking, credentials and fragment, or null.

    Addresses are read and written as the URL standard does (``web_address.parsed``); those that it would leave
    as they are, most of all, are taken apart by one pattern.
    """
    trimmed = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"""[.,;:!)\]}'"]+$""", "")
    schemed = lambda v: (
        F.when((v == "") | v.rlike(r"\s"), F.lit(None)).when(v.startswith("//"), F.concat(F.lit("https:"), v)).when(~v.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.concat(F.lit("http://"), v)).otherwise(v)
    )

    def parts(v: Column) -> Column:
        part = lambda k: F.regexp_extract(v, r"^(https?)://([^/?]+)([^?]*)(?:\?(.*))?$", k)
        path = let(part(3), lambda x: F.when(x == "", F.lit("/")).otherwise(x))
        plain = F.struct(part(1).alias("scheme"), part(2).alias("host"), F.lit("").alias("port"), path.alias("path"), part(4).alias("query"))
        return F.when(v.rlike(web_address.PLAIN), plain).otherwise(web_address.parsed(v))

    def joined(p: Column) -> Column:
        host = F.regexp_replace(p["host"], r"\.$", "")
        ok = F.contains(host, F.lit(".")) & ~host.startswith(".") & ~F.contains(host, F.lit(".."))
        asked = let(_asked(F.coalesce(p["query"], F.lit(""))), lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
        port = F.when(p["port"] == "", F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))
        return F.when(ok, F.concat(p["scheme"], F.lit("://"), host, port, p["path"], asked))

    return let(let(trimmed, schemed), lambda v: let(parts(v), joined))


def own_domain(cleaned: Column) -> Column:
    """The business's own domain: the host without www., null for platforms."""
    return let(host_of(cleaned), lambda h: F.when(platform_kind(h).isNull() & (h != ""), F.regexp_replace(h, r"^www\.", "")))


def same_site(a: Column, b: Column) -> Column:
    """R04."""
    strip = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    return strip(a) == strip(b)


def social_key(host: Column) -> Column:
    """The social network of a host, or null."""
    chain, name = F, F.regexp_replace(host, r"^www\.", "")
    for key, pattern in fixed.SOCIAL_NETWORKS.items():
        chain = chain.when(name.rlike(pattern), F.lit(key))
    return chain.otherwise(F.lit(None).cast("string"))


def maps_url(place_id: Column, name: Column) -> Column:
    """The documented way to open a place by its id."""
    encode = lambda x: F.regexp_replace(F.url_encode(x), r"\+", "%20")
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), encode(name), F.lit("&query_place_id="), encode(place_id))


def link_kind(text: Column, path: Column) -> Column:
    """Kind of page that a link leads to, by priority; null if of no use."""
    squeeze = lambda x: F.regexp_replace(fold(x), r"\s+", " ")
    where, chain = F.concat_ws(" ", squeeze(text), squeeze(F.coalesce(F.try_url_decode(path), path))), F
    for kind, pattern in fixed.LINK_KINDS.items():
        chain = chain.when(where.rlike(pattern), F.lit(kind))
    return chain.otherwise(F.lit(None).cast("string"))


def sitemap_locations(xml: Column) -> Column:
    """The addresses in a sitemap."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def charset(content_type: Column, head: Column) -> Column:
    """Charset by header, else by meta tag, else utf-8."""
    named = lambda x: F.nullif(F.lower(F.regexp_extract(F.coalesce(x, F.lit("")), r"""(?i)charset\s*=\s*["']?([a-z0-9_-]+)""", 1)), F.lit(""))
    return F.coalesce(named(content_type), named(head), F.lit("utf-8"))


def shop_signals(html: Column) -> Column:
    """Sorted signals of selling online on one page."""
    found = [F.when(html.rlike(pattern), F.lit(name)) for name, pattern in fixed.SHOP_SIGNALS.items()]
    cart = html.rlike(fixed.CART_SIGNALS[0])
    for pattern in fixed.CART_SIGNALS[1:]:
        cart = cart | html.rlike(pattern)
    return F.array_sort(F.array_compact(F.array(*found, F.when(cart, F.lit("cart")))))


def looks_javascript_rendered(html: Column) -> Column:
    """Little visible text and the shell of a script-built page."""
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<head\b.*?</head\s*>|<!--.*?-->", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"\s+", " "))
    return (F.length(text) < 200) & html.rlike(fixed.APP_SHELL)
