"""Masks for short sensitive values that only their context gives away, with counts per kind."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in the order in which they are applied.
CODE = r"(?:otp|one[- ]time(?: verification)?(?:\s*\(otp\))? (?:pin|password|passcode|code)|verification code|security code|login code|sign[- ]in code|passcode|pin)"
RULES = (
    ("access_code", "<ACCESS_CODE>", rf"(?P<prefix>\b{CODE}\b(?:\s*(?:(?:is|was)\s*[:=]?|[:=-])\s*|\s+))[\"']?(?P<value>\d{{4,8}})[\"']?\b"),
    ("access_code", "<ACCESS_CODE>", rf"(?<!\d)(?P<value>\d{{4,8}})(?!\d)(?=\s+(?:is\s+)?(?:your\s+)?(?:[A-Za-z][\w.-]*\s+){{0,3}}{CODE}\b)"),
    ("access_code", "<ACCESS_CODE>", rf"(?s)^(?P<prefix>\s*)\d{{4,8}}(?=.{{0,120}}\b{CODE}\b)"),
    ("account_fragment", "<ACCOUNT_NUMBER>", r"(?P<prefix>\b(?:last\s+four(?:\s+digits)?(?:\s+of)?(?:\s+(?:my|your|the))?\s+(?:ssn|social(?:\s+security)?|account(?:\s+number)?|card(?:\s+number)?)|(?:ssn|social(?:\s+security)?|account(?:\s+number)?|card(?:\s+number)?)\s+(?:ending|ends\s+in))\D{0,12})\d{4}\b"),
    ("postal_code", "<POSTAL_CODE>", r"(?P<prefix>\b(?:zip|postal)\s+code\D{0,12})\d{4,10}\b"),
    ("credential", "<CREDENTIAL>", r"(?P<prefix>\b(?:password|credential)\s+(?:is\s+)?)(?P<value>[^\s,;]{4,32})"),
)
_COMPILED = [(kind, mark, re.compile(p, re.I)) for kind, mark, p in RULES]
MASKED = "text string, counts map<string,int>"


def mask(text: str) -> tuple[str, dict[str, int]]:
    counts: dict[str, int] = {}
    for kind, mark, pattern in _COMPILED:

        def one(m: re.Match, kind: str = kind, mark: str = mark) -> str:
            groups = m.groupdict()
            if kind == "credential" and not re.search(r"\d", groups["value"]):
                return m.group(0)
            counts[kind] = counts.get(kind, 0) + 1
            return (groups.get("prefix") or "") + mark

        text = pattern.sub(one, text)
    return text, dict(sorted(counts.items()))


def mask_contextual(text: Column) -> Column:
    """Struct of the masked text and the number of masks per kind."""

    @F.pandas_udf(MASKED)
    def convert(values: pd.Series) -> pd.DataFrame:
        found = [mask(v) if v is not None else (None, {}) for v in values]
        return pd.DataFrame({"text": [f[0] for f in found], "counts": [f[1] for f in found]})

    return convert(text)
