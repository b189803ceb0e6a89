"""The envelope around an answer: confidence, provenance, review reasons, urgency."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Provenance from certain to guessed, urgency from calm to pressing.
PROVENANCE = ("extracted", "inferred", "ambiguous")
URGENCY = ("green", "orange", "red")

#: Below this confidence an answer asks for review.
REVIEW_BELOW = 0.7


@dataclass
class Result:
    """An answer whose payload stays a lazy DataFrame until ``to_json`` is asked for.

    Confidence is clamped to 0..1, a confidence that is no finite number becomes 0. What is not
    certain enough, or is ambiguous, needs review, and an answer that needs review has a reason.
    Guesses are never red.
    """

    ok: bool
    payload: DataFrame | None
    confidence: float = 1.0
    provenance: str = "extracted"
    urgency: str | None = None
    needs_review: bool = False
    review_reasons: list[str] = field(default_factory=list)
    meta: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        c = self.confidence
        self.confidence = min(1.0, max(0.0, float(c))) if isinstance(c, (int, float)) and math.isfinite(c) else 0.0
        if self.provenance not in PROVENANCE:
            self.provenance = "ambiguous"
        if self.urgency == "red" and self.provenance != "extracted":
            self.urgency = "orange"
        if self.confidence < REVIEW_BELOW or self.provenance == "ambiguous":
            self.needs_review = True
        if self.needs_review and not self.review_reasons:
            self.review_reasons.append("low confidence" if self.confidence < REVIEW_BELOW else "rests on ambiguous references")

    def to_json(self, limit: int = 1000) -> str:
        """The answer as JSON with at most ``limit`` rows of its payload."""
        rows = [] if self.payload is None else [json.loads(x) for x in self.payload.limit(limit).toJSON().collect()]
        names = ("ok", "confidence", "provenance", "urgency", "needs_review", "review_reasons", "meta")
        return json.dumps({"result": rows} | {n: getattr(self, n) for n in names}, default=str)


def refuse(reason: str, confidence: float = 0.0) -> Result:
    return Result(False, None, confidence, "ambiguous", needs_review=True, review_reasons=[reason])


def share_confidence(extracted: int, total: int) -> float:
    """Confidence of an answer of which so many parts are extracted."""
    return round(0.4 + 0.5 * extracted / total, 2) if total else 0.9
