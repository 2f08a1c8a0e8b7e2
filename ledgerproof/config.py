"""Settings and fixed values.

`Settings` is an ordinary frozen dataclass that callers pass to operators; the
values end up as literals in the plan, so nothing is looked up on executors.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    confidence_threshold: float = 0.75
    classify_threshold: float = 0.6
    max_attempts: int = 5
    backoff_base_seconds: int = 10
    stale_lock_minutes: int = 10
    min_layer_chars: int = 20
    max_upload_bytes: int = 15 * 1024 * 1024
    max_pages: int = 25
    allowed_mime_types: tuple[str, ...] = ("application/pdf", "image/png", "image/jpeg")
    cheap_model: str = "cheap"
    strong_model: str = "strong"
    cheap_price_in: float = 0.30
    cheap_price_out: float = 2.50
    strong_price_in: float = 1.25
    strong_price_out: float = 10.00
    classify_chars: int = 2000
    error_chars: int = 2000
    list_limit: int = 200
    image_dpi: int = 200
    points_dpi: int = 72
    max_window: int = 8
    amount_tolerance: float = 0.02
    eval_tolerance: float = 0.01


DEFAULTS = Settings()

# The invoice record.
REQUIRED_FIELDS = ("supplier", "invoice_number", "invoice_date", "total")
ALL_FIELDS = (
    "supplier", "invoice_number", "invoice_date", "due_date",
    "currency", "subtotal", "tax", "total",
)
TEXT_FIELDS = ("supplier", "invoice_number", "currency")
DATE_FIELDS = ("invoice_date", "due_date")
NUMBER_FIELDS = ("subtotal", "tax", "total")

# Life cycle names.
DOCUMENT_STATUSES = (
    "uploaded", "parsed", "classified", "extracted", "validated",
    "approved", "needs_review", "failed", "rejected",
)
TERMINAL_STATUSES = ("approved", "needs_review", "failed", "rejected")
JOB_STAGES = ("parse", "classify", "extract", "validate")
JOB_STATUSES = ("queued", "processing", "done", "failed")

# MIME type to file extension.
EXTENSIONS = {"application/pdf": "pdf", "image/png": "png", "image/jpeg": "jpg"}

# Leading bytes (hex) of the three accepted file kinds.
SIGNATURES = {
    "application/pdf": "25504446",
    "image/png": "89504E470D0A1A0A",
    "image/jpeg": "FFD8FF",
}

# Currency codes accepted on a record.
CURRENCY_CODES = (
    "USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "NZD", "CNY", "HKD",
    "SGD", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF", "RON", "BGN", "TRY",
    "INR", "IDR", "MYR", "THB", "PHP", "VND", "KRW", "ZAR", "BRL", "MXN",
    "AED", "SAR", "ILS", "EGP", "NGN", "KES", "PKR", "BDT", "LKR", "RUB",
    "UAH", "ARS", "CLP", "COP", "PEN", "TWD",
)

# Names that must not occur in an uploaded file's bytes.
STRUCTURE_DENYLIST = (
    "/JavaScript", "/JS", "/Launch", "/EmbeddedFile", "/OpenAction",
    "/AA", "/SubmitForm", "/ImportData", "/RichMedia", "/GoToR",
)

# Phrases that try to steer a model, and SQL payload shapes.
INJECTION_PHRASES = (
    "ignore previous instructions",
    "ignore all previous instructions",
    "ignore the above instructions",
    "disregard previous instructions",
    "disregard all prior instructions",
    "disregard the above",
    "new instructions:",
    "system prompt",
    "reveal your instructions",
    "reveal your system prompt",
    "print your instructions",
    "override your instructions",
    "forget your instructions",
    "forget everything above",
    "do anything now",
    "jailbreak",
    "<system>",
    "</system>",
    "[system]",
)
SQL_PHRASES = (
    "' or '1'='1",
    '" or "1"="1',
    "' or 1=1",
    "' or 'a'='a",
    "or 1=1--",
    "'; drop table",
    "drop table",
    "union select",
    "select * from",
    "insert into",
    "delete from",
    "xp_cmdshell",
    "exec(",
    "execute immediate",
    "waitfor delay",
    "sleep(",
    "benchmark(",
    "pg_sleep(",
    "information_schema.tables",
    "'; --",
    "' --",
    "/*!",
)
