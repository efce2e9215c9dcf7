"""A labeler that needs no network: keyword rules over the review text."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from echolens.schemas import FALLBACK_THEME


@dataclass(frozen=True)
class KeywordLabeler:
    """First theme with a keyword in the text; sentiment by which word list has more of its words in it."""

    themes: Mapping[str, Sequence[str]] = field(default_factory=dict)
    positive: Sequence[str] = ("love", "great", "easy", "good")
    negative: Sequence[str] = ("crash", "bug", "slow", "error")
    requests: Sequence[str] = ("wish", "would be nice", "please add")

    def label(self, review_id: str, text: str) -> dict:
        lowered = text.lower()

        def hits(words: Sequence[str]) -> int:
            return sum(word in lowered for word in words)

        balance = hits(self.positive) - hits(self.negative)
        theme = next((name for name, words in self.themes.items() if hits(words)), FALLBACK_THEME)
        return {
            "reviewId": review_id,
            "theme": theme,
            "sentiment": "positive" if balance > 0 else "negative" if balance < 0 else "neutral",
            "severity": min(5, 1 + hits(self.negative)) if balance < 0 else 1,
            "featureRequest": hits(self.requests) > 0,
            "directQuote": re.split(r"[.\n]", text, maxsplit=1)[0],
            "confidence": 0.9 if balance else 0.6,
        }

    def __call__(self, system_prompt: str, reviews: list[tuple[str, str]]) -> str:
        return json.dumps([self.label(review_id, text) for review_id, text in reviews])
