"""Messages: text, senders, links, keywords and scam signals as columns.

Patterns speak of white space and digits in the sense of Unicode, which Java's \\s and \\d do not.
"""

from __future__ import annotations

import html as _html
import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspend.schemas import DEDICATED_HOSTS, DEDICATED_TYPES, KEYWORDS, PERSONAL_DOMAINS, REDIRECT_HOST, SCAM_CONTACT, SCAM_DIGITS, SCAM_PHRASES, SPACE

URL = rf"""https?://[^{SPACE}<>"']+"""
#: References that end with a semicolon by name; those that need none, the longest first.
NAMED = json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})
BARE = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
#: What browsers take numbers 128 to 159 for, and numbers that stand for nothing.
LATE = json.dumps({str(n): _html.unescape(f"&#{n};") for n in range(128, 160)})
NOTHING = [*range(1, 9), *range(14, 32), 11, 127]


def contains_any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts), F.lit(False))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def _code_point(number: Column) -> Column:
    """The character of a number in a reference."""
    known = F.element_at(F.from_json(F.lit(LATE), "map<string, string>"), number.cast("string"))
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    none = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return F.when(none, "\ufffd").when(number.between(128, 159), known).when(
        number.isin(*NOTHING) | (number.bitwiseAND(0xFFFE) == 0xFFFE) | number.between(0xFDD0, 0xFDEF), ""
    ).otherwise(plain)


def unescape(text: Column, only: tuple[str, ...] | None = None) -> Column:
    """Character references decoded as browsers do: by name, decimal and hexadecimal, with or without semicolon.

    only: just these, as they stand between ampersand and semicolon; all others stay as they are.
    """
    table = F.from_json(F.lit(NAMED), "map<string, string>")

    def decoded(part: Column) -> Column:
        """What stood behind an ampersand."""
        digits, hexa = F.regexp_extract(part, "^#([0-9]+);?", 1), F.regexp_extract(part, "^#[xX]([0-9a-fA-F]+);?", 1)
        name, bare = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*);", 1), F.regexp_extract(part, f"^({BARE})", 1)
        rest = lambda pattern: F.regexp_replace(part, pattern, "")
        number = lambda x, base: F.conv(F.right(F.concat(F.lit("000000000"), x), F.lit(9)), base, 10).cast("long")
        long_ = lambda x: F.length(F.regexp_replace(x, "^0+", "")) > 8
        of = lambda x, base: F.when(long_(x), F.lit(None).cast("long")).otherwise(number(x, base))
        return (
            F.when(digits != "", F.concat(_code_point(of(digits, 10)), rest("^#[0-9]+;?")))
            .when(hexa != "", F.concat(_code_point(of(hexa, 16)), rest("^#[xX][0-9a-fA-F]+;?")))
            .when(F.map_contains_key(table, name), F.concat(F.element_at(table, name), rest("^[A-Za-z0-9]+;")))
            .when(bare != "", F.concat(F.element_at(table, bare), F.substr(part, F.length(bare) + 1)))
            .otherwise(F.concat(F.lit("&"), part))
        )

    def chosen(part: Column) -> Column:
        wanted = F.contains(part, F.lit(";")) & F.substring_index(part, ";", 1).isin(*only)
        return F.when(wanted, decoded(part)).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    later = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decoded if only is None else chosen)
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(later, ""))).otherwise(text)


def html_to_text(html: Column, only: tuple[str, ...] | None = None) -> Column:
    """Tags become spaces, character references are decoded (see unescape), white space collapses."""
    text = unescape(F.regexp_replace(html, r"<[^>]+>", " "), only)
    return F.btrim(F.regexp_replace(text, rf"[{SPACE}]+", " "), F.lit(" "))


def urls(text: Column) -> Column:
    """Distinct links in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(URL), 0))


def scam_reason(text: Column, low: Column | None = None) -> Column:
    """Why a text looks like an offer of fake invoices; null if it doesn't.  The first rule wins.

    low: a column with the text in lower case, so that it is not made anew for each phrase.
    """
    low = F.lower(text) if low is None else low
    # phrases come in a fixed order; the rest of the chain is only reached without any
    phrase = F.get(F.filter(F.array(*map(F.lit, SCAM_PHRASES)), lambda p: F.contains(low, p)), F.lit(0))
    signs = F.when(text.rlike(SCAM_CONTACT), "wechat/qq contact inline").when(text.rlike(SCAM_DIGITS), "obfuscated phone/contact digits")
    return F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(F.concat(F.lit("scam phrase: "), phrase), signs))


def has_keyword(text: Column, extra: list[str] | None = None, low: Column | None = None) -> Column:
    return contains_any(F.lower(text) if low is None else low, [*KEYWORDS, *(extra or [])])


def mailbox(from_addr: Column) -> Column:
    """Between the last '<' and the last '>' if they stand so, else the whole, in lower case."""
    low = F.lower(from_addr)
    inner = F.regexp_extract(low, r"<([^<]*)>[^>]*$", 1)
    return F.when(low.rlike(r"<[^<]+>[^>]*$"), inner).otherwise(low)


def domain(box: Column) -> Column:
    return F.when(F.contains(box, F.lit("@")), F.substring_index(box, "@", -1)).otherwise("")


def comma_list(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.lower(strip(x))), lambda x: x != "")


def is_trusted(from_addr: Column, patterns: list[str]) -> Column:
    """Exact mailbox for x@y; domain or sub-domain for @d; else domain, sub-domain or any part of the sender."""
    low, box = F.lower(from_addr), mailbox(from_addr)
    at = domain(box)
    out = F.lit(False)
    for p in (x.strip().lower() for x in patterns):
        if not p:
            continue
        if "@" in p and not p.startswith("@"):
            out = out | (box == p)
            continue
        d = p.removeprefix("@")
        under = (at != "") & ((at == d) | F.endswith(at, F.lit(f".{d}")))
        out = out | under if p.startswith("@") else out | under | F.contains(low, F.lit(p))
    return out


def account_kinds(kind: Column, host: Column, username: Column) -> dict[str, Column]:
    """personal: a mailbox of one of the personal domains; dedicated: a type or host with its own limits."""
    at = F.when(F.contains(username, F.lit("@")), F.lower(F.substring_index(username, "@", -1))).otherwise("")
    return {
        "personal": at.isin(*PERSONAL_DOMAINS),
        "dedicated": F.lower(F.coalesce(kind, F.lit(""))).isin(*DEDICATED_TYPES) | F.lower(F.coalesce(host, F.lit(""))).isin(*DEDICATED_HOSTS)
    }


def is_redirect(url: Column) -> Column:
    """Whether a link is wrapped by the mail provider's redirect."""
    return F.contains(F.coalesce(url, F.lit("")), F.lit(REDIRECT_HOST))


def fallback_id(subject: Column, sender: Column, date: Column, index: Column) -> Column:
    """The id of a message that has none: a digest of what it says; missing parts are empty."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("pop3-"), F.sha2(F.concat_ws("|", blank(subject), blank(sender), blank(date), blank(index)), 256))


RFC_2822 = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")
ISO = ("yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS][.SSSSSS][.SSS][XXX][XX]", "yyyy-MM-dd HH:mm[:ss][.SSSSSSSSS][.SSSSSS][.SSS][XXX][XX]", "yyyy-MM-dd")


def instant(text: Column) -> Column:
    """A time as mail writes it: ISO, with Z, an offset or none (then it is UTC), or RFC 2822 with or without weekday.

    null for anything else.  The session's time zone has to be UTC.
    """
    t = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*\([^)]*\)\s*$", ""), r"(?:GMT|UTC|UT)$", "+0000")
    mail = [F.try_to_timestamp(t, F.lit(f)) for f in RFC_2822]
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ISO), *mail)


def download_name(url: Column, content_type: Column) -> Column:
    """The file name guessed for a link: by the suffix of its path, then by the content type, else a PDF."""
    suffix = F.regexp_extract(F.substring_index(url, "?", 1), r"[^/](\.(?:pdf|xml|ofd))$", 1)
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    has = lambda x: F.contains(kind, F.lit(x))
    return F.concat(
        F.lit("download"),
        F.when(suffix != "", suffix).when(has("pdf"), ".pdf").when(has("xml"), ".xml").when(has("ofd") | has("zip"), ".ofd").otherwise(".pdf")
    )


def enrichment_text(body: Column, document: Column) -> Column:
    """What an extractor reads: the document, after the message's text where there is any."""
    whole = F.concat(F.lit("[Email context]\n"), body, F.lit("\n[/Email context]\n\n[Attachment text]\n"), document, F.lit("\n[/Attachment text]"))
    return F.when(F.coalesce(body, F.lit("")) != "", whole).otherwise(document)


def analysis_text(subject: Column, sender: Column, body: Column, links: Column) -> Column:
    """What a message analyser reads: subject, sender, the first 2000 characters of the body and the links."""
    listed = F.concat_ws("\n", F.transform(links, lambda x: F.concat(F.lit("  <url>"), x, F.lit("</url>"))))
    block = F.when(listed == "", "  (none)").otherwise(listed)
    return F.concat(
        F.lit("Subject: "), subject, F.lit("\nFrom: "), sender, F.lit("\nBody:\n"), F.substring(body, 1, 2000), F.lit("\n\n<links>\n"), block,
        F.lit("\n</links>")
    )


def embedding_text(buyer: Column, seller: Column, summary: Column) -> Column:
    """Buyer, seller and summary, joined by blanks."""
    return F.concat(buyer, F.lit(" "), seller, F.lit(" "), F.coalesce(summary, F.lit("")))


def iso(column: Column | str, zone: str = "") -> Column:
    """A time in ISO form, microseconds only where there are any."""
    c = F.col(column) if isinstance(column, str) else column
    fraction = F.date_format(c, "SSSSSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit(zone))
