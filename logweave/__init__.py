"""logweave — log parsing, PII redaction and log analysis as Spark DataFrame operators."""

from .config import EventType, LaneRule, Mask, Pattern, RedactionConfig, Remove, Replace, Token
from .operators.parse import parse_logs
from .operators.process import process
from .operators.redact import redact, redaction_stats
from .session import configure

__all__ = [
    "EventType", "LaneRule", "Mask", "Pattern", "RedactionConfig", "Remove", "Replace", "Token",
    "configure", "parse_logs", "process", "redact", "redaction_stats",
]
__version__ = "0.1.0"
