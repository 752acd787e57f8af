"""What a text gives away, as categories: the ingestion gate's detector where no other is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions.text import reasons

#: Path and text to the categories found; any column function of this form can take the place of `findings`.
Detector = Callable[[Column, Column], Column]
#: Forms of well-known tokens, names that announce a secret, and what says that a literal is none.
FORMS = (
    (r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", "private-key"), (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "cloud-key"), (r"\bgh[pousr]_[A-Za-z0-9]{30,}\b", "service-token"),
    (r"\bxox[abp]-[A-Za-z0-9-]{20,}", "service-token"), (r"://[^\s/:@\"'`]+:[^\s/@\"'`${}<>]{6,}@", "address-password"),
)
NAMED = r"(?i)(?:api[_-]?key|secret|token|passw(?:or)?d|credential)\w*[\"']?\s*[:=]\s*[\"']([^\"'\s]{16,})[\"']"
HARMLESS = r"(?i)^(?:EXAMPLE_NOT_A_SECRET|TEST_TOKEN_DO_NOT_USE|\$\{.*\}|<.*>|[x*.]+|changeme.*|your[_-].*)\z"


def findings(path: Column, text: Column) -> Column:
    """Categories found in a text, distinct and sorted; quoted values of announcing names count unless they say they are none."""
    values = F.regexp_extract_all(text, F.lit(NAMED), F.lit(1))
    quoted = F.exists(values, lambda v: ~v.rlike(HARMLESS) & (F.size(F.array_distinct(F.split(v, ""))) >= 6))
    return F.array_sort(F.array_distinct(reasons(*((text.rlike(p), name) for p, name in FORMS), (quoted, "named-literal"))))


def contains_secret(text: Column, detector: Detector = findings) -> Column:
    """Whether a generated text gives anything away."""
    return F.coalesce(F.size(detector(F.lit(""), text)) > 0, F.lit(False))
