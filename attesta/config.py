"""Every threshold, weight and switch, in one frozen value that is passed to the operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    # Span tiers and weights
    strong_span: float = 0.55
    weak_span: float = 0.40
    weight_semantic: float = 0.40
    weight_lexical: float = 0.30
    weight_rank: float = 0.30
    # Confidence bands and weights
    band_high: float = 0.75
    band_medium: float = 0.60
    band_moderate: float = 0.45
    band_weak: float = 0.25
    conf_semantic: float = 0.40
    conf_lexical: float = 0.25
    conf_consistency: float = 0.20
    conf_span_count: float = 0.08
    conf_source_diversity: float = 0.07
    calibration: float = 1.35
    per_extra_span: float = 0.25
    consistency_agreed: float = 1.0
    consistency_single: float = 0.7
    consistency_none: float = 0.4
    diversity_three: float = 1.0
    diversity_two: float = 0.6
    # Badges
    badge_strong: float = 0.60
    badge_moderate: float = 0.45
    partial_strong: float = 0.50
    partial_moderate: float = 0.38
    # Retrieval
    top_k: int = 5
    min_score: float = 0.05
    rank_floor: float = 0.2
    # Hygiene
    min_span_words: int = 4
    min_words_before_cut: int = 4
    noise_numeric: float = 0.40
    noise_numeric_fragment: float = 0.25
    garbage_letters: float = 0.55
    garbage_chars: int = 10
    # Definitions
    definition_factor: float = 0.60
    definition_cap: float = 0.59
    definition_discard: float = 0.40
    # Segmentation
    chunk_chars: int = 800
    chunk_flush: int = 200
    page_chars: int = 3000
    docx_paragraphs: int = 12
    # Fetching
    fetch_timeout: float = 20
    fetch_tries: int = 3
    fetch_pause: float = 1
    fetch_per_second: float = 4
    # Themes
    theme_vocabulary: int = 400
    theme_candidates: int = 12
    themes: int = 6
    theme_merge: float = 0.45
    boost_one: float = 0.6
    boost_two: float = 1.4
    boost_three: float = 1.6
    # Switches
    flags: dict[str, bool] = field(
        default_factory=lambda: {
            "auto_theme": True, "pdf_highlight": True, "input_docx": True, "input_csv": True, "input_xlsx": True, "input_url": True,
            "export_json": True, "export_docx": True, "export_xlsx": True, "evidence_quality_filter": True, "evidence_type_labels": True,
            "definition_downweight": True, "source_diversity_bonus": True, "llm_theme_synthesis": True,
            "llm_evidence_selection": False, "llm_adversarial_review": False, "llm_confidence": False, "llm_scoring": False,
        }
    )
    #: One word a line; the default is the English list that scikit-learn documents.
    stop_words_file: str = str(Path(__file__).with_name("data") / "english_stop_words.txt")

    def is_enabled(self, flag: str) -> bool:
        """Unknown flags are off."""
        return bool(self.flags.get(flag, False))

    @cached_property
    def stop_words(self) -> tuple[str, ...]:
        return tuple(Path(self.stop_words_file).read_text(encoding="utf-8").split())


DEFAULT = Settings()
