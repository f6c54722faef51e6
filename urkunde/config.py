"""Settings of a run. They are read on the driver; their values become literals of the plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Modes, eras and the approaches that suit an era.
MODES = ("research", "production", "archive", "interactive")
ERAS = ("1920-1933", "1933-1945", "1945-1970", "1970-1990", "1990-2025")
ERA_APPROACHES = {
    "1920-1933": ("fraktur_traditional", "fraktur_enhanced", "mixed_period"),
    "1933-1945": ("fraktur_enhanced", "official_document", "mixed_period"),
    "1945-1970": ("mixed_period", "official_document", "modern_german"),
    "1970-1990": ("official_document", "modern_german", "standard"),
    "1990-2025": ("modern_german", "official_document", "light"),
}
OTHER_ERA = ("modern_german", "standard", "light")
BY_MODE: dict[str, dict] = {
    "research": {"max_approaches_to_try": 8, "enable_debug": True, "save_confidence_maps": True, "enable_ground_truth_comparison": True},
    "production": {"max_approaches_to_try": 4, "early_exit_confidence": 0.75, "enable_parallel_processing": True, "save_intermediate_images": False},
    "archive": {"max_approaches_to_try": 3, "early_exit_confidence": 0.7, "enable_parallel_processing": True, "max_workers": 8, "enable_interactive_mode": False},
    "interactive": {"enable_interactive_mode": True, "save_intermediate_images": True},
}


class DocumentError(Exception):
    """Any failure with a document."""


class OcrError(DocumentError):
    """Text recognition failed."""


class ValidationError(DocumentError):
    """A record is not valid."""


class PatternError(DocumentError):
    """A rule cannot be used."""


class ConfigurationError(DocumentError):
    """Settings contradict."""


@dataclass(frozen=True)
class ProcessingConfig:
    """All settings. Those that no operator reads (confidence_threshold, memory_limit_mb, ...) are accepted and kept."""

    # Names and defaults of the settings.
    dpi: int = 300
    confidence_threshold: float = 0.7
    output_directory: str = "output_smart_ocr"
    enable_debug: bool = False
    processing_mode: str = "interactive"
    ocr_language: str = "deu"
    tesseract_config: str = ""
    fallback_languages: tuple[str, ...] = ("deu", "deu_frak")
    enable_transkribus: bool = False
    transkribus_model_id: str | None = None
    enable_smart_analysis: bool = True
    enable_interactive_mode: bool = True
    auto_select_best_approach: bool = True
    max_approaches_to_try: int = 6
    early_exit_confidence: float = 0.8
    early_exit_min_length: int = 100
    era_preferences: dict[str, tuple[str, ...]] = field(default_factory=dict)
    excluded_approaches: tuple[str, ...] = ()
    preferred_approaches: tuple[str, ...] = ()
    processing_timeout_seconds: int = 300
    enable_parallel_processing: bool = False
    max_workers: int = 4
    memory_limit_mb: int = 2048
    save_intermediate_images: bool = False
    save_analysis_results: bool = True
    save_detailed_logs: bool = True
    save_confidence_maps: bool = False
    generate_processing_report: bool = True
    enable_cross_page_analysis: bool = True
    metadata_consolidation_strategy: str = "confidence_weighted"
    max_pages_to_process: int | None = None
    enable_ground_truth_comparison: bool = False
    ground_truth_directory: str | None = None
    save_extraction_metrics: bool = False

    def __post_init__(self) -> None:
        if self.processing_mode not in MODES:
            raise ConfigurationError(f"no such mode: {self.processing_mode}")
        changes: dict = {"confidence_threshold": min(1.0, max(0.0, self.confidence_threshold))}
        if not self.era_preferences:
            changes["era_preferences"] = dict(ERA_APPROACHES)
        if self.enable_debug:  # before the mode has its say
            changes |= {"save_intermediate_images": True, "save_analysis_results": True, "save_detailed_logs": True}
        for name, value in (changes | BY_MODE[self.processing_mode]).items():
            object.__setattr__(self, name, value)

    def but(self, **changes) -> ProcessingConfig:
        """These settings with changes that no mode overrides."""
        out = replace(self)
        for name, value in changes.items():
            object.__setattr__(out, name, value)
        return out

    def approaches_for(self, era: str) -> tuple[str, ...]:
        return tuple(self.era_preferences.get(era, OTHER_ERA))

    def summary(self) -> dict:
        shown = (
            "processing_mode", "dpi", "confidence_threshold", "ocr_language", "max_approaches_to_try", "early_exit_confidence",
            "enable_parallel_processing", "max_workers",
        )
        return {k: getattr(self, k) for k in shown}


def for_era(era: str, output_directory: str | None = None) -> ProcessingConfig:
    if era not in ERAS:
        raise ConfigurationError(f"no such era: {era}")
    out = ProcessingConfig(output_directory=output_directory or f"output_{era.replace('-', '_')}")
    if era in ERAS[:2]:
        return out.but(ocr_language="deu_frak", confidence_threshold=0.6, max_approaches_to_try=8)
    return out.but(confidence_threshold=0.65, max_approaches_to_try=6) if era == ERAS[2] else out.but(confidence_threshold=0.75, max_approaches_to_try=4)


def for_research(output_directory: str = "output_research") -> ProcessingConfig:
    return ProcessingConfig(
        processing_mode="research", output_directory=output_directory, enable_debug=True, save_extraction_metrics=True, max_approaches_to_try=10, confidence_threshold=0.5
    )


def for_archive(output_directory: str = "output_batch") -> ProcessingConfig:
    return ProcessingConfig(processing_mode="archive", output_directory=output_directory, enable_interactive_mode=False, processing_timeout_seconds=120)


def example(debug: bool = True) -> ProcessingConfig:
    return ProcessingConfig(enable_debug=debug, confidence_threshold=0.6, output_directory="output/smart_ocr_example", save_intermediate_images=True, max_approaches_to_try=5)


for_fraktur_documents = lambda: for_era(ERAS[1])
for_modern_documents = lambda: for_era(ERAS[4])
for_quick_processing = for_archive
