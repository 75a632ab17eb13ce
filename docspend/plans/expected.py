"""Expected values and patterns of the queries' SQL, written out on their own: nothing here is read from the engine."""

from __future__ import annotations


def listed(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def any_of(text: str, *parts: str) -> str:
    """Whether a text holds any of the parts."""
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


# Fixed values.
KEYWORDS = (
    "发票", "invoice", "开票", "报销", "税务", "fapiao", "receipt", "vat", "增值税", "电子发票", "数电票",
    "购物凭证", "消费凭证", "购物发票", "订单完成", "交易成功", "支付凭证", "發票",
)
SCAM_PHRASES = ("代开", "代开发票", "代开各行业", "有发票出售", "出售发票", "提供发票", "发票业务", "联系微信", "微信号", "加微信", "加qq", "联系qq")
TYPES = (
    "增值税专用发票", "增值税普通发票", "增值税电子专用发票", "增值税电子普通发票",
    "增值税普通发票（卷票）", "通行费发票",
    "电子发票（增值税专用发票）", "电子发票（普通发票）", "全面数字化的电子发票",
    "电子发票（铁路电子客票）", "电子发票（航空运输电子客票行程单）",
    "数电专票", "数电普票", "电子专票", "电子普票",
    "机动车销售统一发票", "二手车销售统一发票",
    "01", "03", "04", "08", "10", "11", "14", "15", "0910", "0920",
)
TICKETS = ("电子发票（铁路电子客票）", "电子发票（航空运输电子客票行程单）")
TICKET_WORDS = ("铁路电子客票", "铁路客运", "航空运输电子客票行程单", "电子行程单")
VAT_WORDS = (
    "增值税专用发票", "增值税普通发票", "电子发票（增值税专用发票）", "电子发票（普通发票）",
    "增值税电子专用发票", "增值税电子普通发票", "全面数字化的电子发票", "数电专票", "数电普票",
    "机动车销售统一发票",
)
VAT_MARKS = ("价税合计", "税率", "税额", "发票号码")
NO_INVOICE = ("入住凭证", "住宿凭证", "结账单", "消费清单", "行程单", "出行记录", "用车凭证", "收款收据", "付款凭证")
QR_CODES = ("01", "03", "04", "08", "10", "11", "14", "15")
BLOCKED_HOSTS = (
    "linktrace.triggerdelivery.com", "click.linksynergy.com", "beacon.mailchimp.com", "trk.klclick.com",
    "t.e.apple.com", "click.e.usps.com", "email.analytics", "click.mail", "tracking.pixel",
)
BLOCKED_PATHS = ("/unsubscribe", "/track/", "/trk/", "/open/", "/click?", "/beacon", "/pixel")
IMAGES = (".gif", ".jpg", ".jpeg", ".png", ".webp", ".ico", ".svg")
PERSONAL = ("outlook.com", "hotmail.com", "live.com", "live.cn", "live.co.uk", "live.fr", "live.de", "live.it", "live.jp", "msn.com", "passport.com")

# Fixed patterns: they must equal the expected ones for right results.
#: White space of Unicode inside a character class, as the SQL's patterns write it.
WS = r"\s\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NUMBER = rf"发票号码[：:{WS}]*(\p{{Nd}}{{8,20}})"
DATE = rf"开票日期[：:{WS}]*(\p{{Nd}}{{4}})[{WS}]*年[{WS}]*(\p{{Nd}}{{1,2}})[{WS}]*月[{WS}]*(\p{{Nd}}{{1,2}})[{WS}]*日"
BUYER = rf"购[{WS}]*买[{WS}]*方.*?名[{WS}]*称[：:{WS}]*(.+?)(?:\n|纳税|统一)"
SELLER = rf"销[{WS}]*售[{WS}]*方.*?名[{WS}]*称[：:{WS}]*(.+?)(?:\n|纳税|统一)"
TOTAL = rf"价税合计[（(]大写[）)].*?[¥￥][{WS}]*([\p{{Nd}},]+\.\p{{Nd}}{{2}})"
TOTAL_ELSE = rf"合[{WS}]*计.*?[¥￥][{WS}]*([\p{{Nd}},]+\.\p{{Nd}}{{2}})"
CONTACT = rf"(?i)(微信|weixin|wechat|qq)[{WS}:：]*[a-zA-Z0-9_-]{{5,20}}"
DIGITS = rf"(?:\p{{Nd}}[{WS}/\-_<>+*\.\|丨]{{1,4}}){{4,}}\p{{Nd}}"


def scam(text: str) -> str:
    """The reason why a text is an offer of fake invoices."""
    phrases = " ".join(f"WHEN contains(lower({text}), '{p}') THEN 'scam phrase: {p}'" for p in SCAM_PHRASES)
    return f"CASE WHEN COALESCE({text}, '') = '' THEN NULL {phrases} WHEN regexp_matches({text}, '{CONTACT}') THEN 'wechat/qq contact inline' WHEN regexp_matches({text}, '{DIGITS}') THEN 'obfuscated phone/contact digits' END"


def day(year: str, month: str, dom: str) -> str:
    return f"TRY_CAST(lpad({year}, 4, '0') || '-' || lpad({month}, 2, '0') || '-' || lpad({dom}, 2, '0') AS DATE)"


def first(text: str, pattern: str, group: int = 1) -> str:
    return f"NULLIF(regexp_extract({text}, '{pattern}', {group}), '')"


def money(text: str) -> str:
    return f"TRY_CAST(trim(replace({text}, ',', '')) AS DECIMAL(12,2))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def fields(source: str) -> str:
    """What the patterns find in raw_text, under the names of the fields."""
    t = "raw_text"
    return (
        f"SELECT *, {first(t, NUMBER)} AS invoice_no, {day(*(first(t, DATE, i) for i in (1, 2, 3)))} AS invoice_date, {strip(first(t, BUYER))} AS buyer, {strip(first(t, SELLER))} AS seller, "
        f"{money(f'COALESCE({first(t, TOTAL)}, {first(t, TOTAL_ELSE)})')} AS amount FROM {source}"
    )


def known_type(x: str) -> str:
    return f"(COALESCE({x}, '') IN ({listed(*TYPES)}) OR {any_of(f'COALESCE({x}, chr(0))', *(v for v in TYPES if len(v) > 3))})"


def vat_document(t: str = "raw_text") -> str:
    marks = " + ".join(f"CAST(contains({t}, '{m}') AS INT)" for m in VAT_MARKS)
    return f"(NOT {any_of(t, *NO_INVOICE)} AND {any_of(t, *VAT_WORDS)} AND {marks} >= 2)"


# Tag names by field.
TAGS = {
    "invoice_no": ("InvoiceNo", "fpHm", "invoiceNumber", "InvoiceNumber", "FPHM", "EInvoiceNumber"),
    "buyer": ("BuyerName", "gmfMc", "buyerName", "GMF_MC", "Gfmc", "GMFMC", "PayingPartyName"),
    "seller": ("SellerName", "xsfMc", "sellerName", "XSF_MC", "XSFMC", "InvoicingPartyName"),
    "invoice_type": ("InvoiceType", "fplx", "invoiceType", "FPLX", "KPLX", "EInvoiceName"),
    "amount": ("TaxInclusiveTotalAmount", "jshj", "totalAmount", "TotalAmount", "JSHJ", "TotalIncludingTax", "PriceTaxTotal", "价税合计"),
    "invoice_date": ("InvoiceDate", "kprq", "invoiceDate", "IssueDate", "KPRQ", "IssueDateTime", "开票日期"),
}
ITEMS = ("GoodsName", "xmmc", "goodsName", "Spmc", "XMMC", "ItemName")


def xml_text(field: str) -> str:
    """The first text by tag, one without a prefix before others; these documents have no markup inside the fields."""
    forms = (f"NULLIF(regexp_extract(raw_text, '<{prefix}{tag}>([^<]+)', 1), '')" for tag in TAGS[field] for prefix in ("", "n:"))
    return f"CASE WHEN whole THEN replace({strip(f'COALESCE({', '.join(forms)})')}, '&amp;', '&') END"


def xml_invoice(source: str) -> str:
    """Documents (raw_text, XML) with their fields."""
    items = "list_concat(" + ", ".join(f"regexp_extract_all(raw_text, '<(?:n:)?{tag}>([^<]+)', 1)" for tag in ITEMS) + ")"
    texts = ", ".join(f"{xml_text(f)} AS {f}" for f in TAGS)
    points = "CASE WHEN COALESCE(invoice_no, '') <> '' THEN 30 ELSE 0 END + CASE WHEN amount > 0 THEN 25 ELSE 0 END + CASE WHEN invoice_date IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN COALESCE(buyer, '') <> '' THEN 10 ELSE 0 END + CASE WHEN COALESCE(seller, '') <> '' THEN 10 ELSE 0 END"
    return f"""SELECT * EXCLUDE (whole, found), CASE WHEN whole AND len(found) > 0 THEN array_to_string(found[1:5], '; ') END AS item_summary, 'xml_xpath' AS extraction_method,
      CASE WHEN whole THEN ({points} + CASE WHEN {known_type('invoice_type')} THEN 10 ELSE 0 END) / 100.0 ELSE 0.0 END::DOUBLE AS confidence, whole AND {vat_document()} AS is_vat_document
      FROM (SELECT * REPLACE ({money('amount')} AS amount, {qr_day('invoice_date')} AS invoice_date) FROM (SELECT *, {texts}, {items} AS found FROM (SELECT *, ends_with(raw_text, '</n:Invoice>') AS whole FROM {source}) y0) y1) y2"""


CONFIDENCE = "CAST((CASE WHEN invoice_no IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN amount > 0 THEN 25 ELSE 0 END + CASE WHEN invoice_date IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN buyer <> '' THEN 10 ELSE 0 END + CASE WHEN seller <> '' THEN 10 ELSE 0 END) / 100.0 AS DECIMAL(3,2))"


def qr(source: str) -> str:
    """id, code, invoice_no, amount, date of the payloads (qr) of a source with an id."""
    part = lambda i: f"NULLIF(trim(string_split(trim(qr), sep)[{i}]), '')"
    at = lambda i, name: f"CASE WHEN seven THEN {part(i + 2)} ELSE {part(i)} END AS {name}"
    head = "trim(string_split(trim(qr), sep)[1])"
    return f"""SELECT id, code, invoice_no, amount, date FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY sep) AS rn, code, invoice_no, amount, date FROM (
    SELECT id, sep, {at(1, 'code')}, {at(2, 'invoice_no')}, {at(3, 'amount')}, {at(4, 'date')} FROM (
      SELECT *, len(string_split(trim(qr), sep)) >= 7 AND {head} = '01' AND trim(string_split(trim(qr), sep)[2]) IN ({listed(*QR_CODES)}) AS seven,
        len(string_split(trim(qr), sep)) = 5 AND length({head}) BETWEEN 10 AND 12 AND regexp_matches({head}, '^[0-9]+$') AS five
      FROM {source} p, (VALUES (','), ('|')) s(sep) WHERE NOT regexp_matches(qr, '^https?://')) a WHERE seven OR five) b) d WHERE rn = 1"""


def qr_day(x: str) -> str:
    eight = day(f"substring({x}, 1, 4)", f"substring({x}, 5, 2)", f"substring({x}, 7, 2)")
    forms = " ".join(
        f"WHEN regexp_matches({x}, '{p}') THEN {day(*(f"regexp_extract({x}, '{p}', {i})" for i in (1, 2, 3)))}" for p in (
            "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", "^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日"
        )
    )
    return f"CASE WHEN length({x}) = 8 AND regexp_matches({x}, '^[0-9]+$') THEN {eight} {forms} END"


def ticket() -> str:
    words = " OR ".join(any_of(f"COALESCE({x}, chr(0))", *TICKET_WORDS) for x in ("invoice_type", "item_summary", "raw_text"))
    return f"(COALESCE(invoice_type, '') IN ({listed(*TICKETS)}) OR (COALESCE(length(invoice_no) = 20 AND regexp_matches(invoice_no, '^[0-9]+$'), FALSE) AND ({words})))"


LOW_AMOUNT = "COALESCE(amount < 0.10, FALSE)"
FIRM = "COALESCE(length(invoice_no) IN (8, 20) AND regexp_matches(invoice_no, '^[0-9]+$'), FALSE)"
STRONG = f"(extraction_method IN ('qr', 'xml_xpath', 'ofd_struct') OR {FIRM})"
NEED = f"((confidence < 0.6 OR COALESCE(invoice_no, '') = '' OR {LOW_AMOUNT} OR COALESCE(buyer, '') IN ('', '未知') OR COALESCE(seller, '') IN ('', '未知') OR COALESCE(invoice_type, '') IN ('', '未知') OR COALESCE(item_summary, '') = '') AND COALESCE(raw_text, '') <> '')"
USE = "(x_valid IS NOT NULL AND (x_valid OR x_category <> 'vat_invoice'))"


def merged(policy: str) -> dict[str, str]:
    """The fields after the selective merge."""
    enough = "x_amount >= 0.10" if policy == "upload" else "x_amount <> 0"
    over = {
        n: f"CASE WHEN {USE} AND COALESCE(x_{n}, '') NOT IN ('', '未知') THEN x_{n} ELSE {n} END" for n in (
            "buyer", "seller", "item_summary", "invoice_type"
        )
    }
    return over | {
        "invoice_no": f"CASE WHEN {USE} AND NOT {FIRM} AND COALESCE(x_invoice_no, '') <> '' THEN x_invoice_no ELSE invoice_no END",
        "invoice_date": f"CASE WHEN {USE} AND invoice_date IS NULL THEN x_invoice_date ELSE invoice_date END",
        "amount": f"CASE WHEN {USE} AND (amount IS NULL OR amount < 0.10) AND x_amount IS NOT NULL AND {enough} THEN x_amount ELSE amount END",
        "extraction_method": f"CASE WHEN {USE} THEN 'llm' ELSE extraction_method END",
        "confidence": f"CASE WHEN {USE} THEN GREATEST(confidence, x_confidence) ELSE confidence END",
    }


def gate(source: str, existing: str, policy: str, order: str) -> str:
    """The intake's decision over parsed and extracted documents, as a chain of CTEs that ends in `done`.

    source gives carried columns (all it has) plus the parsed and x_ fields.
    """
    tickets = ticket() if policy == "upload" else "FALSE"
    spam = "scam_detected" if policy == "upload" else "not_vat_invoice"
    saved, logged = ("saved", "manual_upload_saved") if policy == "upload" else ("saved", "saved")
    why = "CASE WHEN sentinel THEN 'amount below sentinel' WHEN COALESCE(invoice_no, '') = '' THEN 'missing invoice_no' ELSE 'low confidence' END"
    if policy != "upload":
        why = "CASE WHEN sentinel THEN 'amount sentinel' WHEN COALESCE(invoice_no, '') = '' THEN 'invoice_no missing' END"
    text = "concat_ws(' ', NULLIF(buyer, ''), NULLIF(seller, ''), NULLIF(item_summary, ''))"
    replaced = ", ".join(f"{v} AS {k}" for k, v in merged(policy).items())
    return f"""g1 AS (SELECT * REPLACE (CASE WHEN {NEED} THEN x_valid END AS x_valid), {STRONG} AS strong FROM ({source}) q),
    g2 AS (SELECT * REPLACE ({replaced}) FROM g1),
    g3 AS (SELECT *, {tickets} AS ticket, {known_type('invoice_type')} AS type_ok, {text} AS words, CASE WHEN x_valid IS NOT NULL THEN x_category ELSE 'vat_invoice' END AS category FROM g2),
    g4 AS (SELECT *, {scam('words')} AS scam, x_valid IS NOT NULL AND NOT x_valid AND NOT strong AND NOT ticket AS refused, {LOW_AMOUNT} AND NOT ticket AS sentinel FROM g3),
    g5 AS (SELECT *, category = 'vat_invoice' AND (refused OR (x_valid IS NULL AND NOT is_vat_document AND NOT type_ok AND NOT ticket)) AS reject,
      confidence < CASE WHEN ticket THEN 0.5 ELSE 0.6 END OR COALESCE(invoice_no, '') = '' OR sentinel AS low FROM g4),
    g6 AS (SELECT *, CASE WHEN scam IS NOT NULL THEN '{spam}' WHEN reject THEN 'not_vat_invoice' WHEN low THEN 'low_confidence' END AS o1,
      CASE WHEN scam IS NOT NULL THEN 'scam signal: ' || scam WHEN reject THEN 'type=''' || COALESCE(invoice_type, '') || ''' category=''' || category || ''' llm_rejected=' || CASE WHEN refused THEN 'True' ELSE 'False' END WHEN low THEN {why} END AS detail FROM g5),
    g7 AS (SELECT g6.*, EXISTS (SELECT 1 FROM {existing} i WHERE i.user_id = g6.user_id AND i.invoice_no = g6.invoice_no) AS stored FROM g6),
    g8 AS (SELECT *, row_number() OVER (PARTITION BY o1 IS NULL AND NOT stored, user_id, invoice_no ORDER BY {order}) AS nth FROM g7),
    done AS (SELECT *, COALESCE(o1, CASE WHEN NOT stored AND nth = 1 THEN '{saved}' ELSE 'duplicate' END) AS outcome,
      CASE WHEN scam IS NOT NULL THEN 'not_vat_invoice' ELSE COALESCE(o1, CASE WHEN NOT stored AND nth = 1 THEN '{logged}' ELSE 'duplicate' END) END AS audit FROM g8)"""


def safe(x: str) -> str:
    clean = f"trim(regexp_replace(regexp_replace(COALESCE({x}, ''), '[/\\\\:*?\"<>|]', '_', 'g'), '_+', '_', 'g'), '_')"
    return f"COALESCE(NULLIF(rtrim(substring({clean}, 1, 40), '_'), ''), 'unknown')"


MAILBOX = "CASE WHEN regexp_matches(lower(from_addr), '<[^<]+>[^>]*$') THEN regexp_extract(lower(from_addr), '<([^<]*)>[^>]*$', 1) ELSE lower(from_addr) END"
TRUSTED = f"(contains(lower(from_addr), 'src4') OR (contains({MAILBOX}, '@') AND (split_part({MAILBOX}, '@', -1) = 'pay.vendor.example' OR ends_with(split_part({MAILBOX}, '@', -1), '.pay.vendor.example'))))"
DOCUMENT = "CASE WHEN contains(attachment, '.') AND lower(split_part(attachment, '.', -1)) IN ('pdf', 'xml', 'ofd') THEN attachment WHEN contains(attachment2, '.') AND lower(split_part(attachment2, '.', -1)) IN ('pdf', 'xml', 'ofd') THEN attachment2 END"


def rules(source: str) -> str:
    """source with scam, document and rule, the number of the first rule that holds."""
    return f"""SELECT *, CASE WHEN lower(header) = 'list-unsubscribe' THEN 1 WHEN scam IS NOT NULL THEN 2 WHEN document IS NOT NULL THEN 3 WHEN {TRUSTED} THEN 4
      WHEN attachment IS NULL AND link IS NULL AND NOT {any_of('lower(t)', *KEYWORDS)} THEN 5 END AS rule
    FROM (SELECT *, {scam('t')} AS scam, {DOCUMENT} AS document FROM (SELECT *, subject || ' ' || substring(body_text, 1, 2000) AS t FROM {source} e0) e1) e2"""
