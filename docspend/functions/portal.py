"""Invoice portals, and the record a message analyser returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: they must equal the expected ones for right results.
LINK = r"(https://invoice\.stripe\.com/i/[^\s\"'<>]+)"
MONEY = r"(?:US\$|[$€£¥])\s?[\d,]+(?:\.\d{1,2})?"
DAY = r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},\s+\d{4}"
BILL_TO = r"Billing\s*information\s*Name\s+([A-Z][A-Za-z\s&]+?)\s*(?:Email|Billing|Tax|$)"
NO_NAME = "Billing Contact"


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(LINK), 1))


def link_id(url: Column) -> Column:
    """The fifth part of an /i/ link, else the last part; 64 characters at most."""
    parts = F.filter(F.split(F.substring_index(url, "?", 1), "/"), lambda p: p != "")
    shaped = (F.size(parts) >= 5) & (F.get(parts, F.lit(2)) == "i")
    return F.substring(F.when(shaped, F.get(parts, F.lit(4))).when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise("invoice"), 1, 64)


def bill_to(text: Column) -> Column:
    name = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), BILL_TO, 1))
    return F.when(F.length(name).between(2, 80), name).otherwise(NO_NAME)


ANALYSIS = "is_invoice_related boolean, invoice_confidence double, best_download_url string, url_confidence double, url_is_safelink boolean, url_kind string, skip_reason string, extraction_hints struct<platform: string, likely_formats: array<string>, invoice_type_hint: string, visible_invoice_no: string, visible_invoice_date: string, visible_amount: string, parser_notes: string>"
# The kinds that a record may name.
URL_KINDS = ("direct_file", "platform_download", "safelink_wrapped", "none")
PLATFORMS = ("nuonuo", "baiwang", "aisino", "chinatax", "jd", "alipay", "other", "unknown")
FORMATS = ("pdf", "xml", "ofd")


def violations(record: Column) -> Column:
    """The rules that an analysis record breaks."""
    url, related = record["best_download_url"], record["is_invoice_related"]
    score = F.coalesce(record["url_confidence"], F.lit(0.0))
    kind = F.coalesce(record["url_kind"], F.lit("none"))
    hints = record["extraction_hints"]
    rules = {
        "skip_reason with invoice": related & record["skip_reason"].isNotNull(),
        "no skip_reason": ~related & (F.coalesce(record["skip_reason"], F.lit("")) == ""),
        "url without invoice": ~related & url.isNotNull(),
        "url_confidence without url": url.isNull() & (score != 0),
        "safelink without url": url.isNull() & F.coalesce(record["url_is_safelink"], F.lit(False)),
        "url_kind without url": url.isNull() & (kind != "none"),
        "unknown url_kind": ~kind.isin(*URL_KINDS),
        "unknown platform": ~F.coalesce(hints["platform"], F.lit("unknown")).isin(*PLATFORMS),
        "unknown format": F.exists(F.coalesce(hints["likely_formats"], F.array().cast("array<string>")), lambda x: x.isNull() | ~x.isin(*FORMATS)),
        "score out of range": ~record["invoice_confidence"].between(0, 1) | ~score.between(0, 1),
    }
    return F.array_compact(F.array(*(F.when(test, name) for name, test in rules.items())))


def is_valid(record: Column) -> Column:
    """Whether a record has what it must have and breaks no rule."""
    return F.coalesce(record["is_invoice_related"].isNotNull() & record["invoice_confidence"].isNotNull() & (F.size(violations(record)) == 0), F.lit(False))


def should_download(record: Column) -> Column:
    return record["best_download_url"].isNotNull() & (F.coalesce(record["url_confidence"], F.lit(0.0)) >= 0.6)
