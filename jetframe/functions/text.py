"""Text scans: secret redaction, script detection, reference extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
URL_SECRET = r"(?i)([?&](?:token|sig|signature|key|credential)=)[^&\s]+"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+"
CJK = "[㐀-䶿一-鿿豈-﫿]"
MARKDOWN_LINK = r"(?:^|[^!])\[[^\]]+\]\(([^)]+)\)"
HREF = r'href="([^"]*)"'
EXTERNAL = "^(http://|https://|mailto:|#)"


def redact(text: Column, literals: Sequence[str] = ()) -> Column:
    """Hide URL credentials, bearer tokens and the given literal secrets."""
    out = F.regexp_replace(text, URL_SECRET, "$1[REDACTED]")
    out = F.regexp_replace(out, BEARER, "Bearer [REDACTED]")
    for secret in literals:
        if secret:
            out = F.replace(out, F.lit(secret), F.lit("[REDACTED]"))
    return out


def first_cjk(text: Column) -> Column:
    """First CJK character, or an empty string."""
    return F.regexp_extract(text, CJK, 0)


def link_targets(text: Column, pattern: str = MARKDOWN_LINK) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def local_target(raw: Column) -> Column:
    """Target path without fragment or angle brackets; empty for external links."""
    first = F.regexp_replace(F.split(F.trim(raw), r"\s+")[0], "^[<>]+|[<>]+$", "")
    return F.when(first.rlike(EXTERNAL), F.lit("")).otherwise(F.split(first, "#")[0])
