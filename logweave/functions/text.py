"""Column-expression building blocks for text work (no Python UDFs).

Every helper returns a ``Column`` that runs JVM-side on every executor.
Lambda functions (``transform``, ``zip_with``) are evaluated by Spark's
interpreter inside the generated stage, not compiled with it.
"""

from __future__ import annotations

import hashlib
import logging
import re
import re._constants as re_constants
import re._parser as re_parser
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def jre(pattern: str, ignore_case: bool = False) -> str:
    """Python-syntax pattern → Java pattern with Unicode classes.

    ``(?U)`` makes ``\\w \\d \\s \\b`` Unicode-aware (as in Python 3) and implies
    Unicode case folding for ``(?i)``. Named groups and references to them
    are rewritten (Java names have no underscore, so they are numbered).
    """
    names: dict[str, str] = {}

    def group(m: re.Match) -> str:
        if m.group(1):  # an escaped character
            return m.group(0)
        return f"(?<{names.setdefault(m.group(2), f'g{len(names)}')}>" if m.group(2) else f"\\k<{names.get(m.group(3), m.group(3))}>"

    if "(?P" in pattern:
        pattern = re.sub(r"(\\.)|\(\?P<(\w+)>|\(\?P=(\w+)\)", group, pattern)
    return ("(?Ui)" if ignore_case else "(?U)") + pattern


def quote_replacement(text: str) -> str:
    """Literal text for the replacement argument of ``regexp_replace``."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


MARK = "\ue000"  # a private-use character, not a regex metacharacter


def sub_matches(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``fn(match)`` — match-wise substitution.

    One regex pass wraps every match in a marker character
    (``regexp_replace(text, p, M$0M)``); cutting at the marker (String.split's
    no-regex fast path) gives pieces and matches alternately, and the matches
    (odd positions) go through ``fn``. Text that already holds the marker
    takes a two-pass path (``split`` by the pattern + ``regexp_extract_all``).
    Patterns must not match the empty string.
    """
    wrapped = F.split(F.regexp_replace(text, pattern, MARK + "$0" + MARK), MARK, -1)
    one_pass = F.array_join(
        F.transform(wrapped, lambda x, i: F.when(i % 2 == 1, F.coalesce(fn(x), F.lit(""))).otherwise(x)), ""
    )
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    two_pass = F.array_join(
        F.zip_with(pieces, hits, lambda a, b: F.concat(a, F.when(b.isNull(), "").otherwise(F.coalesce(fn(b), F.lit(""))))),
        "",
    )
    return F.when(text.contains(MARK), two_pass).otherwise(one_pass)


def has_match(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def _column(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def mask_value(value: Column, head: Column | int, tail: Column | int, char: Column | str = "*") -> Column:
    """The value with everything but its ends overlaid by ``char``; too short a value stays as it is."""
    head, tail, char = _column(head), _column(tail), _column(char)
    middle = F.length(value) - (head + tail)
    hidden = F.overlay(value, F.repeat(char, middle), head + 1, middle)
    return F.when(middle > 0, hidden).otherwise(value)


def _hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\x00")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(value: Column, key: str) -> Column:
    """HMAC-SHA256 (RFC 2104) of the UTF-8 bytes of ``value`` as lower-case hex.

    The key is padded on the driver once; each row costs two ``sha2`` calls.
    """
    ipad, opad = _hmac_pads(key.encode("utf-8"))
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(ipad)), F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(opad)), inner), 256)


def token_value(value: Column, key: str, prefix: Column | str) -> Column:
    """``[PREFIX_xxxxxxxx]`` — first 8 hex digits of the keyed hash."""
    return F.concat(F.lit("["), _column(prefix), F.lit("_"), F.substring(hmac_sha256_hex(value, key), 1, 8), F.lit("]"))


def strip_text(c: Column) -> Column:
    """Python ``str.strip()`` for Unicode whitespace."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def short_service(c: Column) -> Column:
    """Last two dot-separated parts of a service name."""
    return F.when(c.contains("."), F.substring_index(c, ".", -2)).otherwise(c)


def needed_literal(pattern: str) -> str | None:
    """The longest literal (two characters at least) that every match of a Python pattern holds, if one is plain to see.

    Only characters outside alternatives, optional parts and look-arounds
    count; a pattern that ignores case has none.
    """
    parsed = re_parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE or "(?i" in pattern:
        return None
    runs = [""]

    def walk(items) -> None:
        for op, arg in items:
            if op is re_constants.LITERAL:
                runs[-1] += chr(arg)
            elif op is re_constants.SUBPATTERN and not (arg[1] or arg[2]):
                walk(arg[3])
            elif op in (re_constants.MAX_REPEAT, re_constants.MIN_REPEAT, re_constants.POSSESSIVE_REPEAT) and arg[0] >= 1:
                walk(arg[2])
                runs.append("")  # what follows need not stand behind the first turn
            elif op is not re_constants.AT:  # an anchor takes no room
                runs.append("")

    walk(parsed)
    best = max(runs, key=len)
    return best if len(best) >= 2 else None


def any_literal(literals: list[str]) -> str:
    """A Java pattern that finds any of the literals: most places fail at one test of the first character."""
    firsts = "".join(sorted({f"\\x{{{ord(x[0]):x}}}" for x in literals}))
    return f"(?=[{firsts}])(?:" + "|".join("\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E" for x in sorted(set(literals))) + ")"


def usable_pattern(pattern: str, substitutes: bool = False) -> bool:
    """Whether a user's pattern can be applied; checked on the driver without a Spark job.

    A pattern Python rejects is skipped with a warning, as is, if it
    ``substitutes``, one that matches the empty string. A pattern Python
    accepts and Java rejects raises: skipping it would leave text unredacted.
    """
    try:
        compiled = re.compile(pattern)
    except re.error as exc:
        log.warning("skipping invalid pattern %r: %s", pattern, exc)
        return False
    if substitutes and compiled.search(""):
        log.warning("skipping pattern %r: it matches the empty string", pattern)
        return False
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(jre(pattern))
        except Exception as exc:
            raise ValueError(f"pattern {pattern!r} is valid in Python but not in Java: {exc}") from exc
    return True
