"""A bank of detectors of personal data and the merging of what they find, inside the row and without shuffles.

Spans are array<struct<start, end, type, confidence>>, zero-based code points, half open. A detector may name
its data by a word before it ("MRN: ..."); its span is that of the capture group alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.operators.spans import Detector, folded, found

# Day patterns, detectors with their confidences, and the priority of types.
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t|tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_NUMERIC = r"(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:\d{4}|\d{2})"
_WORDED = _MONTH + r"\s+\d{1,2},?\s+\d{2,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

DETECTORS = (
    Detector("EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0.98, holds="@"),
    Detector("PHONE", r"(?i)(?<!\d)(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}(?:\s*(?:x|ext\.?|extension)\s*\d{1,6})?(?!\d)", 0.95),
    Detector("SSN", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", 0.98, holds="-"),
    Detector("SSN", r"(?i)\b(?:SSN|SOCIAL SECURITY(?: NUMBER)?)\b[\s:#-]*(\d{9}|\d{3}-\d{2}-\d{4})\b", 0.97, 1),
    Detector("DATE", rf"(?<!\d){_NUMERIC}(?!\d)", 0.83),
    Detector("DATE", r"\b\d{4}-\d{2}-\d{2}\b", 0.82, holds="-"),
    Detector("DATE", rf"(?i)\b{_WORDED}\b", 0.82),
    Detector("DATE", rf"(?i)\b(?:DOB|DATE OF BIRTH)\b[\s:#-]*({_NUMERIC}|\d{{4}}-\d{{2}}-\d{{2}}|{_WORDED})\b", 0.9, 1),
    Detector("MRN", r"(?i)\b(?:MRN|MEDICAL RECORD(?: NUMBER)?|PATIENT ID)\b[\s:#-]*([A-Z0-9][A-Z0-9-]{3,})\b", 0.93, 1),
    Detector("ACCOUNT", r"(?i)\b(?:ACCOUNT(?: NUMBER| NO\.?)?|ACCT(?: NUMBER| NO\.?)?)\b[\s:#-]*([A-Z0-9][A-Z0-9-]{3,})\b", 0.92, 1),
    Detector("URL", r"""(?i)\b(?:https?://|www\.)[^\s<>"']+""", 0.95),
    Detector("IP", rf"(?<!\d){_OCTET}(?:\.{_OCTET}){{3}}(?!\d)", 0.9, holds="."),
)
PRIORITY = {"SSN": 100, "MRN": 95, "ACCOUNT": 90, "EMAIL": 85, "PHONE": 80, "DATE": 70, "IP": 60, "URL": 50}

SPAN = {"start": "int", "end": "int", "type": "string", "confidence": "double"}


def detect(text: Column, detectors: tuple[Detector, ...] = DETECTORS) -> Column:
    """All spans of all detectors by start, the longer first. Empty texts have none, null ones null."""
    return F.transform(found(text, detectors), lambda s: F.struct(*[s[k].alias(k) for k in SPAN]))


def _strength(s: tuple) -> tuple:
    return s[3], PRIORITY.get(s[2], 0), s[1] - s[0]


def _strongest(spans: list[tuple]) -> list[tuple]:
    kept: list[tuple] = []
    for s in spans:
        if not kept or s[0] > kept[-1][1]:
            kept.append(s)
            continue
        old = kept[-1]
        kept[-1] = (old[0], max(old[1], s[1]), s[2] if _strength(s) > _strength(old) else old[2], max(old[3], s[3]))
    return kept


def merge_strongest(spans: Column) -> Column:
    """Ordered spans that overlap or touch become one, with the type and confidence of the strongest: by confidence, then the type's priority, then length."""
    return folded(spans, _strongest, SPAN)


def span_id(*parts: Column) -> Column:
    """The same id for the same span in every run."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16)
