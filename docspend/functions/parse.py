"""Invoice fields from text: numbers, dates, amounts, codes, names and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspend.functions.text import contains_any, strip
from docspend.schemas import (
    CATEGORIES, E_TICKET_MARKERS, E_TICKET_TYPES, NON_INVOICE_MARKERS, SENTINEL, SPACE, UNKNOWN, VALID_TYPES, VAT_REQUIRED_MARKERS, VAT_TYPE_MARKERS,
)

# Fixed patterns: they must equal the expected ones for right results.  White space and digits are
# those of Unicode, and [^\n] stands for any character but a line feed: Java's dot stops at more.
NUMBER = rf"发票号码[：:{SPACE}]*(\p{{Nd}}{{8,20}})"
DATE = rf"开票日期[：:{SPACE}]*(\p{{Nd}}{{4}})[{SPACE}]*年[{SPACE}]*(\p{{Nd}}{{1,2}})[{SPACE}]*月[{SPACE}]*(\p{{Nd}}{{1,2}})[{SPACE}]*日"
BUYER = rf"购[{SPACE}]*买[{SPACE}]*方[^\n]*?名[{SPACE}]*称[：:{SPACE}]*([^\n]+?)(?:\n|纳税|统一)"
SELLER = rf"销[{SPACE}]*售[{SPACE}]*方[^\n]*?名[{SPACE}]*称[：:{SPACE}]*([^\n]+?)(?:\n|纳税|统一)"
TOTAL = rf"价税合计[（(]大写[）)][^\n]*?[¥￥][{SPACE}]*([\p{{Nd}},]+\.\p{{Nd}}{{2}})"
TOTAL_ELSE = rf"合[{SPACE}]*计[^\n]*?[¥￥][{SPACE}]*([\p{{Nd}},]+\.\p{{Nd}}{{2}})"
QR_CODES = ("01", "03", "04", "08", "10", "11", "14", "15")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


WIDE = "０１２３４５６７８９"


def narrow(text: Column) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(text, WIDE, "0123456789")


def day(year: Column, month: Column, dom: Column) -> Column:
    """A date, null if there is no such day; each part is found once, and a day that is none throws nothing, as it would where a pattern is parsed."""
    y, m, d = (F.lpad(narrow(x), n, "0") for x, n in ((year, 4), (month, 2), (dom, 2)))
    return F.concat(y, F.lit("-"), m, F.lit("-"), d).try_cast("date")


def amount(text: Column) -> Column:
    return narrow(strip(F.replace(text, F.lit(","), F.lit("")))).try_cast("decimal(12,2)")


def qr_date(text: Column) -> Column:
    """Eight digits; or year-month-day, or year, month and day with their signs, as a prefix."""
    t = F.trim(text)
    eight = day(F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))
    dash, sign = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{4})年(\d{1,2})月(\d{1,2})日"
    return F.when(t.rlike(r"^\d{8}$"), eight).when(
        t.rlike(dash), day(*(found(t, dash, i) for i in (1, 2, 3)))
    ).when(t.rlike(sign), day(*(found(t, sign, i) for i in (1, 2, 3))))


def qr_fields(raw: Column) -> Column:
    """code, number, amount and date of a QR payload; null for links and unknown forms."""
    out = F.when(raw.rlike("^https?://"), F.lit(None).cast("struct<code: string, invoice_no: string, amount: string, date: string>"))
    for sep in (",", "\\|"):
        p = F.transform(F.split(F.trim(raw), sep), lambda x: F.trim(x))
        part = lambda i, p=p: F.nullif(F.get(p, F.lit(i)), F.lit(""))
        pick = lambda at, part=part: F.struct(*(part(at + i).alias(n) for i, n in enumerate(("code", "invoice_no", "amount", "date"))))
        out = out.when((F.size(p) >= 7) & (F.get(p, F.lit(0)) == "01") & F.get(p, F.lit(1)).isin(*QR_CODES), pick(2))
        out = out.when((F.size(p) == 5) & F.get(p, F.lit(0)).rlike(r"^\d{10,12}$"), pick(0))
    return out


def fields(text: Column) -> dict[str, Column]:
    """What the patterns find in a document's text."""
    return {
        "invoice_no": found(text, NUMBER),
        "invoice_date": day(*(found(text, DATE, i) for i in (1, 2, 3))),
        "buyer": strip(found(text, BUYER)),
        "seller": strip(found(text, SELLER)),
        "amount": amount(F.coalesce(found(text, TOTAL), found(text, TOTAL_ELSE))),
    }


def is_valid_type(kind: Column) -> Column:
    k = F.coalesce(kind, F.lit(""))
    return k.isin(*VALID_TYPES) | contains_any(k, [v for v in VALID_TYPES if len(v) > 3])


def given(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def confidence(invoice_no: Column, buyer: Column, seller: Column, total: Column, date: Column, kind: Column) -> Column:
    """Evidence for the fields, 0 to 1, exact to two places."""
    part = lambda test, points: F.when(test, F.lit(points)).otherwise(F.lit(0)).cast("int")
    points = part(given(invoice_no), 30) + part(
        F.coalesce(total > 0, F.lit(False)), 25
    ) + part(date.isNotNull(), 15) + part(given(buyer), 10) + part(given(seller), 10) + part(given(kind) & is_valid_type(kind), 10)
    return (F.least(points, F.lit(100)) / 100).cast("decimal(3,2)")


def is_vat_document(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    required = sum((F.contains(t, F.lit(m)).cast("int") for m in VAT_REQUIRED_MARKERS), F.lit(0))
    return ~contains_any(t, NON_INVOICE_MARKERS) & contains_any(t, VAT_TYPE_MARKERS) & (required >= 2)


def is_garbled(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\(cid:\d+\)")) > 5


def digits_number(invoice_no: Column, *lengths: int) -> Column:
    return F.coalesce(invoice_no.rlike("^(?:" + "|".join(rf"\d{{{n}}}" for n in lengths) + ")$"), F.lit(False))


def is_e_ticket(kind: Column, invoice_no: Column, summary: Column, text: Column) -> Column:
    where = [F.coalesce(c, F.lit("")) for c in (kind, summary, text)]
    marked = contains_any(where[0], E_TICKET_MARKERS) | contains_any(where[1], E_TICKET_MARKERS) | contains_any(where[2], E_TICKET_MARKERS)
    return where[0].isin(*E_TICKET_TYPES) | digits_number(invoice_no, 20) & marked


def is_sentinel(total: Column) -> Column:
    return F.coalesce(total < F.lit(SENTINEL).cast("decimal(12,2)"), F.lit(False))


def is_strong(method: Column, invoice_no: Column) -> Column:
    return method.isin("qr", "xml_xpath", "ofd_struct") | digits_number(invoice_no, 8, 20)


def should_enrich(conf: Column, invoice_no: Column, total: Column, buyer: Column, seller: Column, kind: Column, summary: Column, text: Column) -> Column:
    missing = lambda c: ~given(c) | (c == UNKNOWN)
    wanting = missing(buyer) | missing(seller) | missing(kind) | ~given(summary)
    return ((conf < 0.6) | ~given(invoice_no) | is_sentinel(total) | wanting) & given(text)


def safe_component(text: Column, most: int = 40) -> Column:
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r'[/\\:*?"<>|\x00-\x1f]', "_")
    clean = F.btrim(F.regexp_replace(clean, "_+", "_"), F.lit("_"))
    clean = F.when(F.length(clean) > most, F.rtrim(F.substring(clean, 1, most), F.lit("_"))).otherwise(clean)
    return F.when(clean == "", "unknown").otherwise(clean)


def clean_extension(extension: Column) -> Column:
    """Letters, digits, dots, _ and - only, with a dot in front; a PDF's if nothing is left."""
    clean = F.regexp_replace(F.coalesce(extension, F.lit("")), r"[^A-Za-z0-9._-]", "")
    return F.when(clean == "", ".pdf").when(F.startswith(clean, F.lit(".")), clean).otherwise(F.concat(F.lit("."), clean))


def canonical_stem(buyer: Column, seller: Column, invoice_no: Column, date: Column, total: Column) -> Column:
    stamp = F.coalesce(F.date_format(date, "yyyyMMdd"), F.lit("unknown"))
    money = F.coalesce(total, F.lit(0)).cast("decimal(12,2)").cast("string")
    return F.concat_ws("_", safe_component(buyer), safe_component(seller), safe_component(invoice_no), stamp, money)


def canonical_name(buyer: Column, seller: Column, invoice_no: Column, date: Column, total: Column, extension: str | Column = ".pdf") -> Column:
    suffix = clean_extension(F.lit(extension) if isinstance(extension, str) else extension)
    return F.concat(canonical_stem(buyer, seller, invoice_no, date, total), suffix)


def is_traversal(path: Column) -> Column:
    """Whether a relative path leaves its root on the way, or is absolute."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(
        parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a,
        p: F.struct(
            (a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(1)).alias("low")
        )
    )
    return F.startswith(path, F.lit("/")) | (depth["low"] < 0)


def category(raw: Column) -> Column:
    """The renamed category, and the default for rows from before there were any."""
    return F.when(raw.isNull(), CATEGORIES[0]).when(raw == "saas_invoice", "overseas_invoice").otherwise(raw)


#: Prompts whose answers grow old soon.
SHORT_LIVED = ("classify", "analyze_email_v3")


def content_hash(prompt_type: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{prompt_type}:"), text), 256)


def expiry(prompt_type: Column, created: Column, short: str = "7 DAYS") -> Column:
    return created + F.when(prompt_type.isin(*SHORT_LIVED), F.expr(f"INTERVAL {short}")).otherwise(F.expr("INTERVAL 365 DAYS"))


def file_format(name: Column, head: Column) -> Column:
    """Format by name first, then by the first characters."""
    ext = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return (
        F.when(ext == "ofd", "ofd")
        .when((ext == "xml") | F.startswith(F.ltrim(head), F.lit("<?xml")), "xml")
        .when((ext == "pdf") | F.startswith(head, F.lit("%PDF")), "pdf")
        .when(F.contains(F.substring(head, 1, 100), F.lit("<?xml")), "xml")
        .otherwise("pdf")
    )
