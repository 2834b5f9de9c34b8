"""Label taxonomy and scoring defaults, passed around as one parameter object."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fine label names, in column order.
FINE_LABELS = [
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion",
    "curiosity", "desire", "disappointment", "disapproval", "disgust", "embarrassment",
    "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism",
    "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
]

# Coarse label -> fine labels that imply it, in coarse label order.
COARSE_SOURCES = {
    "joy": ["amusement", "excitement", "joy", "optimism", "pride", "relief"],
    "trust": ["admiration", "approval", "caring", "gratitude", "love"],
    "fear": ["fear", "nervousness"],
    "surprise": ["surprise", "realization", "confusion"],
    "sadness": ["grief", "remorse", "sadness", "disappointment"],
    "disgust": ["disgust", "embarrassment"],
    "anger": ["anger", "annoyance", "disapproval"],
    "anticipation": ["desire", "curiosity"],
}

# Categories of the word-emotion lexicon, in feature order.
LEXICON_EMOTIONS = [
    "anger", "anticipation", "disgust", "fear", "joy",
    "sadness", "surprise", "trust", "positive", "negative",
]

# Decision threshold per coarse label before tuning.
DEFAULT_THRESHOLDS = {
    "joy": 0.55, "trust": 0.5, "fear": 0.45, "surprise": 0.5,
    "sadness": 0.5, "disgust": 0.45, "anger": 0.5, "anticipation": 0.5,
}

# Fixed values: (tone, headline) used by the narrative sentence.
DESCRIPTORS = {
    "joy": ("uplifting", "bright bursts of joy"),
    "trust": ("reassuring", "steady notes of trust"),
    "fear": ("tense", "undercurrents of fear"),
    "surprise": ("curious", "sparks of surprise"),
    "sadness": ("reflective", "shadows of sadness"),
    "disgust": ("sharp", "flashes of disgust"),
    "anger": ("fiery", "streaks of anger"),
    "anticipation": ("eager", "stirrings of anticipation"),
}

# Thresholds tried when tuning.
THRESHOLD_GRID = [0.3, 0.4, 0.5, 0.6, 0.7]


@dataclass(frozen=True)
class Taxonomy:
    """Everything label-specific that the operators need."""

    fine: list[str] = field(default_factory=lambda: list(FINE_LABELS))
    coarse: dict[str, list[str]] = field(default_factory=lambda: dict(COARSE_SOURCES))
    emotions: list[str] = field(default_factory=lambda: list(LEXICON_EMOTIONS))
    thresholds: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))
    descriptors: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(DESCRIPTORS))

    @property
    def labels(self) -> list[str]:
        return list(self.coarse)
