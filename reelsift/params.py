"""Settings of a curation run."""

from __future__ import annotations

from dataclasses import dataclass

MODELS = ("yolo", "detr", "fasterrcnn")  # also the order in which detections are visited


@dataclass(frozen=True)
class Params:
    # crop
    crop_format: str = "9:16"
    strict_formats: bool = False  # True gives 16:9 and 4:3 their own ratio instead of 9/16
    padding: int = 500
    min_head_space: float = 0.05
    max_head_space: float = 0.25
    min_quality: float = 0.3  # a crop is kept when its quality is strictly above
    # frames
    interval: int = 30
    # text
    skip_text: bool = True
    use_quick_text: bool = True
    min_text_ratio: float = 0.015
    strip_height: float = 0.25
    # detection
    confidence: float = 0.5
    label_map: str = "reference"  # or "canonical": every model's labels on one contiguous id range
    ensemble: bool = False
    models: tuple[str, ...] = MODELS
    voting_threshold: int = 2
    iou_threshold: float = 0.5
    # run
    turbo: bool = True
    batch_size: int = 4

    def __post_init__(self) -> None:
        if self.interval < 1:
            raise ValueError("interval must be at least 1")
        if not 0.0 < self.iou_threshold <= 1.0:
            raise ValueError("iou_threshold must be in (0, 1]")
        if self.label_map not in ("reference", "canonical"):
            raise ValueError("label_map must be 'reference' or 'canonical'")
        unknown = set(self.models) - set(MODELS)
        if unknown or not self.models:
            raise ValueError(f"models must be drawn from {MODELS}, got {self.models}")

    @property
    def effective_threshold(self) -> int:
        """Votes needed: never more than there are models."""
        return min(self.voting_threshold, len(self.models))

    @property
    def active_models(self) -> tuple[str, ...]:
        """A single-model run looks at the first model only."""
        return tuple(m for m in MODELS if m in self.models) if self.ensemble else MODELS[:1]

    @property
    def text_gate_active(self) -> bool:
        return self.skip_text and self.use_quick_text
