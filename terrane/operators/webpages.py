"""Addresses and links on web pages, and the evaluation of a site's addresses."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit, urlunsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import fixed
from terrane.functions.email import decode_cfemail, decode_escapes, deobfuscate, email_domain, email_type, extract_emails, is_disposable, is_own_domain, join_script_strings, normalize_email, primary_rank, reject_reason
from terrane.functions.urls import link_kind, shop_signals

#: Sources of an address, most reliable first.
SOURCES = ("mailto", "cfemail", "jsonld", "text", "obfuscated", "attribute", "script")
#: What a page with any address has in its source: the sign itself, an escape of it, a protected address, or the word.
ADDRESS_HINT = r"(?i)@|＠|%40|&#|&commat|\\u00|\\x40|cfemail|email-protection|[\[({<]\s*at\s*[\])}>]|\bat\b"
SILENT = ("script", "style", "noscript", "template", "svg")
HEADLINES = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (
    *"address article aside blockquote body dd div dl dt fieldset figcaption figure footer form header hr html li main nav ol option p pre section table td th tr ul".split(" "),
    *HEADLINES,
)
SPACED = ("br", "span", "a", *BLOCKS)


class _Parts(HTMLParser):
    """Text, scripts, attributes and links of a page in one walk."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.mailto: list[str] = []
        self.protected: list[str] = []
        self.data: list[str] = []
        self.text: list[str] = []
        self.title: list[str] = []
        self.attributes: list[str] = []
        self.scripts: list[str] = []
        self.links: list[list[str]] = []
        self.silent: list[str] = []
        self.json = False
        self.in_title = False
        self.link: list[str] | None = None
        self.headline: int | None = None
        self.headlines: list[tuple[int, int]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag == "a" and "href" in given:
            href = unquote(given["href"].strip())
            if re.match("(?i)mailto:", href):
                self.mailto += re.split("[,;]", re.sub("(?i)^mailto:", "", href).split("?")[0])
            if "/cdn-cgi/l/email-protection#" in given["href"]:
                self.protected.append(given["href"].split("#", 1)[1])
            self.link = [given["href"].strip(), ""]
            self.links.append(self.link)
        if "data-cfemail" in given:
            self.protected.append(given["data-cfemail"])
        for name, value in given.items():
            if name not in fixed.SKIPPED_ATTRIBUTES and ("@" in value or re.search(r"(?i)%40|&#|\\u00|\\x40", value)):
                self.attributes.append(value)
        if tag in SILENT:
            self.silent.append(tag)
            self.json = tag == "script" and given.get("type") == "application/ld+json"
        elif tag == "title":
            self.in_title = True
        elif tag == "br" or tag in BLOCKS:
            self.text.append(" ")
            if tag in HEADLINES:
                self.headline = len(self.text)

    def handle_endtag(self, tag: str) -> None:
        if self.silent and tag == self.silent[-1]:
            self.silent.pop()
        if tag == "title":
            self.in_title = False
        if tag == "a":
            self.link = None
        if tag in HEADLINES and self.headline is not None:
            self.headlines.append((self.headline, len(self.text)))
            self.headline = None
        if tag in SPACED:
            self.text.append(" ")

    def handle_data(self, data: str) -> None:
        if self.in_title and not self.silent:
            self.title.append(data)
        elif not self.silent:
            self.text.append(data)
            if self.link is not None:
                self.link[1] += data
        elif self.silent[-1] == "script":
            (self.data if self.json else self.scripts).append(data)


def _json_emails(value: object) -> Iterator[str]:
    if isinstance(value, list):
        for item in value:
            yield from _json_emails(item)
    elif isinstance(value, dict):
        for key, inner in value.items():
            if key.lower() == "email" and isinstance(inner, str):
                yield inner
            else:
                yield from _json_emails(inner)


def _without_cut_address(passage: str, text: str) -> str:
    """A headline or attribute without the address at its end, if ``text`` has the passage and there the address goes on.

    Such a passage is a cut: ``Write to anna@shop.co`` of ``Write to anna@shop.com today``. One that is no more than an
    address stays, as ``anna@shop.com`` and ``anna@shop.com.cy`` can be two. ``text`` has single blanks.
    """
    words = re.sub(r"[.\u2026\s]+$", "", passage).split()
    if len(words) < 2 or "@" not in words[-1]:
        return passage
    cut = re.search(re.escape(" ".join(words)) + r"\.?[A-Za-z0-9-]", text)
    return passage[: passage.rindex(words[-1])] if cut else passage


def page_parts(html: str | None) -> dict[str, object]:
    """The raw material of a page for the expressions over it."""
    parser = _Parts()
    parser.feed(html or "")
    parser.close()
    headlines = [(a, b) for a, b in parser.headlines if any("@" in x for x in parser.text[a:b])]
    if headlines or parser.attributes:
        plain = " ".join("".join(parser.text).split())
        for a, b in headlines:
            parser.text[a:b] = [_without_cut_address("".join(parser.text[a:b]), plain), *[""] * (b - a - 1)]
        parser.attributes = [_without_cut_address(x, plain) for x in parser.attributes]
    # The title is no part of the body: its text counts only on a page without any other.
    text, found = "".join(parser.text), []
    for block in parser.data:
        try:
            found += _json_emails(json.loads(block))
        except ValueError:
            continue  # a page's own broken data is no error of ours
    return {"mailto": parser.mailto, "protected": parser.protected, "jsonld": found, "text": text if text.strip() else "".join(parser.title), "attributes": " ".join(parser.attributes), "scripts": "\n".join(parser.scripts), "links": [tuple(x) for x in parser.links]}


PARTS = "mailto array<string>, protected array<string>, jsonld array<string>, text string, attributes string, scripts string, links array<struct<href:string,label:string>>"


def with_parts(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Keys of the pages with their parts, parsed in Arrow batches."""
    kinds = dict(pages.dtypes)
    names = ["mailto", "protected", "jsonld", "text", "attributes", "scripts", "links"]
    texts, link = pa.list_(pa.string()), pa.struct([("href", pa.string()), ("label", pa.string())])
    types = [texts, texts, texts, pa.string(), pa.string(), pa.string(), pa.list_(link)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):  # texts of a page are about as long as the page
                rows = batch.slice(first, 500)
                parts = [page_parts(x) for x in rows.column(len(keys)).to_pylist()]
                for p in parts:
                    p["links"] = [{"href": a, "label": b} for a, b in p["links"]]
                columns = [pa.array([p[n] for p in parts], t) for n, t in zip(names, types, strict=True)]
                yield pa.record_batch([*(rows.column(k) for k in range(len(keys))), *columns], names=[*keys, *names])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + PARTS
    return pages.select(*keys, html).mapInArrow(run, schema)


def _candidates() -> Column:
    """``(source, original)`` of a page in order of source and place."""
    one = lambda values, source: F.transform(values, lambda x: F.struct(F.lit(source).alias("source"), x.alias("original")))
    text = decode_escapes(F.col("text"))
    return F.concat(
        one(F.transform("mailto", decode_escapes), "mailto"),
        one(F.filter(F.transform("protected", decode_cfemail), lambda x: x.isNotNull()), "cfemail"),
        one(F.col("jsonld"), "jsonld"),
        one(extract_emails(text), "text"),
        one(extract_emails(deobfuscate(text)), "obfuscated"),
        one(extract_emails(decode_escapes(F.col("attributes"))), "attribute"),
        one(extract_emails(decode_escapes(join_script_strings(F.col("scripts")))), "script"),
    )


def emails_of_pages(pages: DataFrame) -> DataFrame:
    """``(site, page_order, url, pos, source, original, email)``: each address once a page, with its best source.

    ``pages``: ``(site, page_order, url, html)``. Pages without any sign of an address are not parsed. Domains under
    a reserved name (a headline cut within ``mail.example.com`` leaves one) cannot exist: they are no addresses.
    """
    keys = ["site", "page_order", "url"]
    found = with_parts(pages.where(F.col("html").rlike(ADDRESS_HINT)), keys).select(*keys, F.posexplode(_candidates()).alias("pos", "c")).select(*keys, "pos", "c.source", "c.original")
    valid = found.withColumn("email", normalize_email(F.col("original"))).where("email IS NOT NULL")
    valid = valid.where(~F.substring_index("email", ".", -1).isin(*fixed.RESERVED_ENDINGS))
    picked = F.min(F.struct("pos", "source", "original"))
    return valid.groupBy(*keys, "email").agg(picked.alias("p")).select(*keys, "p.*", "email")


def evaluate_sites(pages: DataFrame, free_domains: DataFrame, mx: DataFrame) -> DataFrame:
    """Each site's addresses with reject reason or class, mail server and the one primary.

    ``mx``: ``(domain, mx_valid)``. Pages count in order; an address counts once a site; those found in
    code only need the site's own or a free-mail domain; ten addresses a site are kept.
    """
    once = emails_of_pages(pages).groupBy("site", "email").agg(F.min(F.struct("page_order", "pos", "source", "original", "url")).alias("p")).select("site", "email", "p.*")
    free = free_domains.select(F.col("domain").alias("f")).distinct().withColumn("is_free_mail", F.lit(True))
    servers = mx.select(F.col("domain").alias("d"), "mx_valid")
    rows = once.withColumn("domain", email_domain(F.col("email")))
    rows = rows.join(free, F.col("domain") == F.col("f"), "left").join(servers, F.col("domain") == F.col("d"), "left").drop("f", "d")
    rows = rows.withColumn("is_free_mail", F.coalesce("is_free_mail", F.lit(False))).withColumn("is_own_domain", is_own_domain(F.col("domain"), F.col("site")))
    hidden = F.col("source").isin("script", "attribute") & ~F.col("is_own_domain") & ~F.col("is_free_mail")
    rows = rows.withColumn("rejected", F.coalesce(reject_reason(F.col("email")), F.when(hidden, F.lit("THIRD_PARTY_IN_CODE"))))
    # A site has at most some hundred addresses; windows over a site are small.
    order = Window.partitionBy("site", F.col("rejected").isNull()).orderBy("page_order", "pos")
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("over_limit", F.col("rejected").isNull() & (F.col("rank") > fixed.MAX_EMAILS_PER_SITE))
    rows = rows.withColumn("email_type", email_type(F.col("email"))).withColumn("is_disposable", is_disposable(F.col("domain")))
    kept = F.col("rejected").isNull() & ~F.col("over_limit")
    score = F.when(kept, primary_rank(F.col("is_own_domain"), F.col("email_type"), F.col("mx_valid"), F.col("email"), F.col("is_disposable")))
    best = Window.partitionBy("site").orderBy(score.desc_nulls_last(), "rank")
    return rows.withColumn("is_primary", kept & (F.row_number().over(best) == 1))


def contact_links(pages: DataFrame) -> DataFrame:
    """``(page_id, url, kind, pos)`` of same-site links to contact, about, legal and privacy pages."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, base, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                strip = lambda h: re.sub(r"^www\.", "", (h or "").lower())
                for href, label in page_parts(html)["links"]:
                    if not href or href.startswith("#") or not base:
                        continue
                    try:
                        to = urlsplit(urljoin(base, href))
                        same = strip(to.hostname) == strip(urlsplit(base).hostname)
                    except ValueError:
                        continue  # not a web address
                    if to.scheme in ("http", "https") and same and not re.search(fixed.FILE_PATH, to.path):
                        target = urlunsplit((to.scheme, to.netloc, to.path or "/", to.query, ""))
                        if target != base:
                            rows.append((page, target, label, to.path or "/", len(rows)))
            yield pd.DataFrame(rows, columns=["page_id", "link", "label", "path", "pos"])

    found = pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, link string, label string, path string, pos long")
    typed = found.withColumn("kind", link_kind(F.col("label"), F.col("path"))).where("kind IS NOT NULL")
    return typed.groupBy("page_id", "link").agg(F.min(F.struct("pos", "kind")).alias("p")).select("page_id", F.col("link").alias("url"), "p.kind", "p.pos")


def selling_signals(pages: DataFrame) -> DataFrame:
    """``(domain, sells_online, signals)`` over all pages of a domain (R08). ``pages``: ``(domain, html)``."""
    found = pages.select("domain", F.explode_outer(shop_signals(F.col("html"))).alias("signal"))
    signals = found.groupBy("domain").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    return signals.select("domain", (F.size("signals") > 0).alias("sells_online"), "signals")
