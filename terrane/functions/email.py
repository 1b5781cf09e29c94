"""Emails: normalisation, finding, keys, classes, reject reasons and rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import fixed
from terrane.functions.urls import is_in_domains, platform_kind


def normalize_email(raw: Column) -> Column:
    """The one normal form of an address, or null if the value is none."""
    value = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), "(?i)^mailto:", "")
    value = F.substring_index(value, "?", 1)
    value = F.regexp_replace(F.regexp_replace(value, fixed.EMAIL_LEADING_JUNK, ""), fixed.EMAIL_TRAILING_JUNK, "")
    value = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
    check = lambda v: F.when((F.length(v) <= 254) & F.length(F.substring_index(v, "@", 1)).between(1, 64) & v.rlike(fixed.EMAIL_PATTERN), v)
    return F.transform(F.array(value), check).getItem(0)


def extract_emails(text: Column) -> Column:
    """All addresses in a text, normalised, distinct, in order of appearance."""
    found = F.transform(F.regexp_extract_all(text, F.lit(fixed.EMAIL_CANDIDATE), F.lit(0)), normalize_email)
    return F.array_distinct(F.filter(found, lambda e: e.isNotNull()))


def email_domain(email: Column) -> Column:
    """After the last @."""
    return F.substring_index(email, "@", -1)


def email_hash(email: Column) -> Column:
    """The suppression key: SHA-256 in hexadecimal digits."""
    return F.sha2(email, 256)


def _mailbox(email: Column) -> Column:
    return F.substring_index(F.substring_index(email, "@", 1), "+", 1)


def is_generic_mailbox(email: Column) -> Column:
    """info@, sales2@, info.city@ and the like."""
    return _mailbox(email).rlike(rf"^(?:{'|'.join(fixed.GENERIC_MAILBOXES)})(?:$|[._-]|\d)")


def is_role_mailbox(email: Column) -> Column:
    """privacy@, dpo@, legal@ and the like."""
    return _mailbox(email).rlike(rf"^(?:{'|'.join(fixed.ROLE_MAILBOXES)})(?:$|[._-]|\d)")


def is_role_address(email: Column) -> Column:
    """The same test as one pattern over the whole address."""
    return email.rlike(rf"^(?:{'|'.join(fixed.ROLE_MAILBOXES)})(?:@|[._+-]|[0-9])")


def email_type(email: Column) -> Column:
    return F.when(is_generic_mailbox(email), F.lit("GENERIC")).otherwise(F.lit("PERSONAL"))


def is_own_domain(domain: Column, website_domain: Column) -> Column:
    """Equal to the site's domain or a subdomain of it, either way."""
    site = F.regexp_replace(website_domain, r"^www\.", "")
    below = lambda x, y: F.endswith(x, F.concat(F.lit("."), y))
    return F.coalesce((site != "") & ((domain == site) | below(domain, site) | below(site, domain)), F.lit(False))


def is_disposable(domain: Column) -> Column:
    """E11."""
    return domain.isin(*fixed.DISPOSABLE_DOMAINS)


def reject_reason(email: Column) -> Column:
    """Why an address is no business contact, first reason first; null if it looks real."""
    domain, local = email_domain(email), F.regexp_replace(email, "@[^@]*$", "")
    return (
        F.when(F.substring_index(domain, ".", -1).isin(*fixed.FILE_ENDINGS), F.lit("FILE_NAME"))
        .when(domain.rlike(fixed.PLACEHOLDER_DOMAIN), F.lit("PLACEHOLDER"))
        .when(is_in_domains(domain, fixed.TECH_DOMAINS), F.lit("TECH_DOMAIN"))
        .when(platform_kind(domain).isNotNull(), F.lit("PLATFORM_DOMAIN"))
        .when(local.rlike(fixed.JUNK_MAILBOX), F.lit("JUNK_LOCAL"))
        .when(local.rlike("^[0-9a-f]{16,}$"), F.lit("HASH_LOCAL"))
    )


def primary_rank(own_domain: Column, kind: Column, mx_valid: Column, email: Column | None = None, disposable: Column | None = None) -> Column:
    """Rank of an address as a place's primary one; ties go to the first found.

    Without ``email`` role mailboxes are not ranked down, without ``disposable`` throw-away ones
    are not, as when a primary is picked anew after a merge.
    """
    mx = F.when(disposable, F.lit(False)).otherwise(mx_valid) if disposable is not None else mx_valid
    score = F.when(own_domain, 100).otherwise(0) + F.when(kind == "PERSONAL", 10).otherwise(0) + F.when(mx == F.lit(False), -1000).when(mx, 1).otherwise(0)
    return score if email is None else score + F.when(is_role_mailbox(email), -500).otherwise(0)


def mx_state(first: Column, second: Column) -> Column:
    """True, false or null from two resolvers."""
    return F.when(first, F.lit(True)).otherwise(F.coalesce(second, first))


def decode_escapes(text: Column) -> Column:
    r"""``@`` and ``.`` out of the escapes that hide them."""
    at = F.regexp_replace(text, fixed.ESCAPED_AT, "@")
    return F.regexp_replace(at, fixed.ESCAPED_DOT, ".")


def deobfuscate(text: Column) -> Column:
    """``info [at] shop [dot] cy`` and its variants as addresses.

    In ``info at shop dot cy`` the words count only together, so the place of ``at`` is marked first
    and each ``dot`` of the same address follows it: right after the mark, or where the last one ended.
    """
    out = F.regexp_replace(text, fixed.BRACKETED_AT, "@")
    out = F.regexp_replace(out, fixed.BRACKETED_DOT, ".")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+AT\s+", "@"), r"\s+DOT\s+", ".")
    out = F.regexp_replace(out, r"(?i)\b([a-z0-9._-]+)\s+at\s+(?=[a-z0-9-]+(?:\s+dot\s+[a-z0-9-]+)+\b)", "$1\ue000")
    out = F.regexp_replace(out, "(?i)(\ue000[a-z0-9.-]+|\\G(?!\\A)[a-z0-9-]+)\\s+dot\\s+(?=[a-z0-9-])", "$1.")
    return F.translate(out, "\ue000", "@")


def decode_cfemail(code: Column) -> Column:
    """The address behind a protected one: hexadecimal bytes, each combined with the first."""
    ok = code.rlike("^(?:[0-9a-fA-F]{2}){2,}$")
    byte = lambda i: F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    plain = F.transform(F.sequence(F.lit(1), F.greatest((F.length(code) / 2).cast("int") - 1, F.lit(1))), lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(byte(F.lit(0)))), 2, "0"))
    return F.when(ok, F.decode(F.unhex(F.array_join(plain, "")), "UTF-8"))


def join_script_strings(code: Column) -> Column:
    """``'info' + '@shop.cy'`` in one piece."""
    return F.regexp_replace(code, fixed.JOINED_STRINGS, "")
