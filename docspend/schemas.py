"""Fixed schemas, enumerations and literal lists."""

from __future__ import annotations

TABLES = {
    "users": "id BIGINT, email STRING, is_active BOOLEAN, is_admin BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
    "user_sessions": "id BIGINT, user_id BIGINT, token_hash STRING, created_at TIMESTAMP, expires_at TIMESTAMP, revoked_at TIMESTAMP, last_seen_at TIMESTAMP, user_agent STRING, ip_address STRING",
    "email_accounts": "id BIGINT, user_id BIGINT, name STRING, type STRING, host STRING, port INT, username STRING, outlook_account_type STRING, is_active BOOLEAN, last_scan_uid STRING, created_at TIMESTAMP, password_encrypted STRING, secondary_credential_encrypted STRING, secondary_password_encrypted STRING, totp_secret_encrypted STRING, playwright_storage_state STRING",
    "invoices": "id BIGINT, user_id BIGINT, invoice_no STRING, buyer STRING, seller STRING, amount DECIMAL(12,2), invoice_date DATE, invoice_type STRING, invoice_category STRING, item_summary STRING, file_path STRING, raw_text STRING, email_uid STRING, email_account_id BIGINT, source_format STRING, extraction_method STRING, confidence DOUBLE, is_manually_corrected BOOLEAN, created_at TIMESTAMP",
    "scan_logs": "id BIGINT, user_id BIGINT, email_account_id BIGINT, started_at TIMESTAMP, finished_at TIMESTAMP, emails_scanned INT, invoices_found INT, error_message STRING",
    "extraction_logs": "id BIGINT, user_id BIGINT, scan_log_id BIGINT, email_uid STRING, email_subject STRING, attachment_filename STRING, outcome STRING, classification_tier INT, parse_method STRING, parse_format STRING, download_outcome STRING, invoice_no STRING, confidence DOUBLE, error_detail STRING, created_at TIMESTAMP",
    "correction_logs": "id BIGINT, user_id BIGINT, invoice_id BIGINT, field_name STRING, old_value STRING, new_value STRING, corrected_at TIMESTAMP",
    "saved_views": "id BIGINT, user_id BIGINT, name STRING, filter_json STRING, created_at TIMESTAMP",
    "webhook_logs": "id BIGINT, user_id BIGINT, event STRING, invoice_no STRING, url STRING, status_code INT, success BOOLEAN, error_detail STRING, created_at TIMESTAMP",
    "llm_cache": "id BIGINT, content_hash STRING, prompt_type STRING, response_json STRING, created_at TIMESTAMP, expires_at TIMESTAMP",
    "app_settings": "key STRING, value STRING, updated_at TIMESTAMP",
}

#: A message of any source, as the intake takes it.
MESSAGE = {
    "email_id": "string", "user_id": "bigint", "account_id": "bigint", "folder": "string", "uid": "string", "uidvalidity": "string", "message_id": "string", "subject": "string",
    "from_addr": "string", "body_text": "string", "body_html": "string", "received_at": "timestamp", "attachments": "array<string>", "links": "array<string>", "headers": "map<string,string>",
}

#: White space of Unicode, for use inside a character class.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# They must equal the expected lists for right results.
CATEGORIES = ("vat_invoice", "receipt", "proforma", "overseas_invoice", "other")
UNKNOWN = "未知"
SENTINEL = "0.10"
VALID_TYPES = (
    "增值税专用发票", "增值税普通发票", "增值税电子专用发票", "增值税电子普通发票",
    "增值税普通发票（卷票）", "通行费发票",
    "电子发票（增值税专用发票）", "电子发票（普通发票）", "全面数字化的电子发票",
    "电子发票（铁路电子客票）", "电子发票（航空运输电子客票行程单）",
    "数电专票", "数电普票", "电子专票", "电子普票",
    "机动车销售统一发票", "二手车销售统一发票",
    "01", "03", "04", "08", "10", "11", "14", "15", "0910", "0920",
)
E_TICKET_TYPES = ("电子发票（铁路电子客票）", "电子发票（航空运输电子客票行程单）")
E_TICKET_MARKERS = ("铁路电子客票", "铁路客运", "航空运输电子客票行程单", "电子行程单")
VAT_TYPE_MARKERS = (
    "增值税专用发票", "增值税普通发票", "电子发票（增值税专用发票）", "电子发票（普通发票）",
    "增值税电子专用发票", "增值税电子普通发票", "全面数字化的电子发票", "数电专票", "数电普票",
    "机动车销售统一发票",
)
VAT_REQUIRED_MARKERS = ("价税合计", "税率", "税额", "发票号码")
NON_INVOICE_MARKERS = ("入住凭证", "住宿凭证", "结账单", "消费清单", "行程单", "出行记录", "用车凭证", "收款收据", "付款凭证")
KEYWORDS = (
    "发票", "invoice", "开票", "报销", "税务", "fapiao", "receipt", "vat", "增值税", "电子发票", "数电票",
    "购物凭证", "消费凭证", "购物发票", "订单完成", "交易成功", "支付凭证", "發票",
)
SCAM_PHRASES = ("代开", "代开发票", "代开各行业", "有发票出售", "出售发票", "提供发票", "发票业务", "联系微信", "微信号", "加微信", "加qq", "联系qq")
SCAM_CONTACT = rf"(?i)(微信|weixin|wechat|qq)[{SPACE}:：]*[a-zA-Z0-9_-]{{5,20}}"
SCAM_DIGITS = rf"(?:\p{{Nd}}[{SPACE}/\-_<>+*\.\|丨]{{1,4}}){{4,}}\p{{Nd}}"
PERSONAL_DOMAINS = ("outlook.com", "hotmail.com", "live.com", "live.cn", "live.co.uk", "live.fr", "live.de", "live.it", "live.jp", "msn.com", "passport.com")
DEDICATED_TYPES = ("qq",)
DEDICATED_HOSTS = ("imap.qq.com", "imap.exmail.qq.com")
REDIRECT_HOST = "safelinks.protection.outlook.com"
BLOCKED_HOSTS = (
    "linktrace.triggerdelivery.com", "click.linksynergy.com", "beacon.mailchimp.com", "trk.klclick.com",
    "t.e.apple.com", "click.e.usps.com", "email.analytics", "click.mail", "tracking.pixel",
)
BLOCKED_PATHS = ("/unsubscribe", "/track/", "/trk/", "/open/", "/click?", "/beacon", "/pixel")
IMAGE_SUFFIXES = (".gif", ".jpg", ".jpeg", ".png", ".webp", ".ico", ".svg")
CONTENT_TYPES = (
    "application/pdf", "application/octet-stream", "application/xml", "text/xml",
    "application/zip", "application/x-zip-compressed", "application/ofd",
)
OUTCOME_PRIORITY = {
    "saved": 100, "success": 100, "duplicate": 80, "skipped_seen": 70, "low_confidence": 60, "not_vat_invoice": 55,
    "scam_detected": 55, "parse_failed": 40, "error": 30, "failed": 30, "not_invoice": 10,
}
BULK_HEADER = "list-unsubscribe"
DOCUMENT_EXTENSIONS = ("pdf", "xml", "ofd")
SKIP_FLAGS = ("\\noselect", "\\drafts", "\\trash", "\\all")
