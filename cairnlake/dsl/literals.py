"""Filter literals as numbers, read once when a filter is compiled."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime

_NUMBER = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf(?:inity)?|nan)\Z", re.I | re.A)
_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.\d+)?([Zz]|[+-]\d\d:\d\d)\Z", re.A)
# The accepted date forms, all taken as UTC.
_FORMS = [
    (re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\Z", re.A), "%Y-%m-%dT%H:%M:%S"),
    (re.compile(r"\d{4}:\d\d:\d\d \d\d:\d\d:\d\d\Z", re.A), "%Y:%m:%d %H:%M:%S"),
    (re.compile(r"\d{4}-\d\d-\d\d\Z", re.A), "%Y-%m-%d"),
]


def number_of(text: str) -> float | None:
    """A number, or the epoch seconds of a date; None for other texts and for NaN, which equals nothing."""
    if _NUMBER.match(text):
        value = float(text)
        return None if math.isnan(value) else value
    try:
        if m := _RFC3339.match(text):
            zone = "+00:00" if m[3] in "Zz" else m[3]
            return float(math.floor(datetime.fromisoformat(f"{m[1]}T{m[2]}{zone}").timestamp()))
        for pattern, form in _FORMS:
            if pattern.match(text):
                return float(datetime.strptime(text, form).replace(tzinfo=UTC).timestamp())
    except ValueError:
        pass
    return None
