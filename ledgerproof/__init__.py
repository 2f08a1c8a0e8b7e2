"""Document trust analytics as Spark DataFrame operators."""

from ledgerproof.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
