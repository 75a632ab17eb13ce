"""Fields of structured (XML) invoices: each document is parsed once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspend.functions.parse import amount, confidence, is_vat_document, qr_date

# Tag names by field, the first that has a text counts.
TAGS = {
    "invoice_no": ("InvoiceNo", "fpHm", "invoiceNumber", "InvoiceNumber", "FPHM", "EInvoiceNumber"),
    "buyer": ("BuyerName", "gmfMc", "buyerName", "GMF_MC", "Gfmc", "GMFMC", "PayingPartyName"),
    "seller": ("SellerName", "xsfMc", "sellerName", "XSF_MC", "XSFMC", "InvoicingPartyName"),
    "invoice_type": ("InvoiceType", "fplx", "invoiceType", "FPLX", "KPLX", "EInvoiceName"),
    "amount": ("TaxInclusiveTotalAmount", "jshj", "totalAmount", "TotalAmount", "JSHJ", "TotalIncludingTax", "PriceTaxTotal", "价税合计"),
    "invoice_date": ("InvoiceDate", "kprq", "invoiceDate", "IssueDate", "KPRQ", "IssueDateTime", "开票日期"),
}
ITEM_TAGS = ("GoodsName", "xmmc", "goodsName", "Spmc", "XMMC", "ItemName")
MOST_ITEMS = 5

#: Encodings the parser knows itself; others are decoded first.
OWN = ("utf-8", "utf8", "utf-16", "iso-8859-1", "us-ascii")


class Broken(ValueError):
    """No well-formed document."""


def elements(document: bytes | str) -> list[tuple[str, bool, str]]:
    """Local name, whether it stands below the root without a namespace, and text before the first child, of all elements.

    Entities that a document declares are not expanded: the text ends there.  Bytes that are no
    document in their own encoding are tried as GBK.
    """
    if isinstance(document, str):
        return _parsed(document.encode(), "utf-8")
    said = re.match(rb"""<\?xml[^>]*?encoding\s*=\s*["']([\w.-]+)""", document.removeprefix(b"\xef\xbb\xbf"))
    encoding = said[1].decode().lower() if said else "utf-8"
    try:
        return _parsed(document, None) if encoding in OWN else _parsed(document.decode(encoding).encode(), "utf-8")
    except (Broken, UnicodeError, LookupError):
        return _parsed(document.decode("gbk", errors="replace").encode(), "utf-8")


def _parsed(document: bytes, encoding: str | None) -> list[tuple[str, bool, str]]:
    out: list[list] = []  # local name, plain, pieces of text
    open_: list[list | None] = []  # pieces of the elements that are open; None once their text has ended
    parser = expat.ParserCreate(encoding, "}")

    def end_text() -> None:
        if open_:
            open_[-1] = None

    def start(name: str, _) -> None:
        end_text()
        space, _, local = name.rpartition("}")
        out.append([local, not space and bool(open_), []])
        open_.append(out[-1][2])

    def text(data: str) -> None:
        if open_ and open_[-1] is not None:
            open_[-1].append(data)

    def other(data: str) -> None:
        if data.startswith("&"):
            end_text()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: open_.pop(), text
    # comments and instructions are nodes too, after which lies no text of the element's own
    parser.CommentHandler, parser.ProcessingInstructionHandler, parser.DefaultHandler = lambda _: end_text(), lambda *_: end_text(), other
    try:
        parser.Parse(document, True)
    except (expat.ExpatError, ValueError) as e:
        raise Broken(str(e)) from e
    return [(name, plain, "".join(parts)) for name, plain, parts in out]


def record(document: bytes | str | None, tags: dict[str, tuple[str, ...]] = TAGS, item_tags: tuple[str, ...] = ITEM_TAGS) -> dict | None:
    """The texts of the fields and the items, None for what is no document.

    Of the elements of a tag the first below the root without a namespace counts if it has a text,
    else the first with a text; a text of white space alone is a text, and empty when trimmed.
    """
    if document is None:
        return None
    try:
        found = elements(document)
    except Broken:
        return None
    by_name: dict[str, list[tuple[bool, str]]] = {}
    for name, plain, text in found:
        by_name.setdefault(name, []).append((plain, text))

    def first(names: tuple[str, ...]) -> str | None:
        for tag in names:
            here = by_name.get(tag, [])
            bare = next((text for plain, text in here if plain), "")
            text = bare or next((text for _, text in here if text), "")
            if text:
                return text.strip()
        return None

    items = [text.strip() for tag in item_tags for _, text in by_name.get(tag, []) if text]
    return {name: first(names) for name, names in tags.items()} | {"items": items[:MOST_ITEMS]}


def xml_fields(text: Column, content: Column | None = None, tags: dict[str, tuple[str, ...]] = TAGS, item_tags: tuple[str, ...] = ITEM_TAGS) -> Column:
    """A struct of texts by field, and items, of XML documents; all fields are null for broken ones.

    A document is given as text or, where content is not null, as bytes.  Each is parsed once.
    """
    names = [*tags, "items"]

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, contents in frames:
            found = (record(t if b is None else b, tags, item_tags) for t, b in zip(texts, contents))
            yield pd.DataFrame([r or dict.fromkeys(names) for r in found], columns=names)

    kind = T.StructType([*(T.StructField(name, T.StringType()) for name in tags), T.StructField("items", T.ArrayType(T.StringType()))])
    # the hints of a nested function are names only, so the kind of the function is stated
    run.__annotations__ = {"frames": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, kind)(text, F.lit(None).cast("binary") if content is None else content)


def xml_invoice(x: Column, text: Column) -> dict[str, Column]:
    """The parsed fields of xml_fields x of a document with this text; no confidence where it is broken."""
    fields = {name: x[name] for name in ("invoice_no", "buyer", "seller", "invoice_type")} | {"amount": amount(x["amount"]), "invoice_date": qr_date(x["invoice_date"])}
    whole = x["items"].isNotNull()
    score = confidence(*(fields[n] for n in ("invoice_no", "buyer", "seller", "amount", "invoice_date", "invoice_type")))
    return fields | {
        "item_summary": F.when(F.size(x["items"]) > 0, F.array_join(x["items"], "; ")), "extraction_method": F.lit("xml_xpath"),
        "confidence": F.when(whole, score.cast("double")).otherwise(0.0), "is_vat_document": whole & F.coalesce(is_vat_document(text), F.lit(False)),
    }
