"""Settings, from keyword arguments, ``FINSTRATA_*`` variables or a .env file, in this order."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Parameters of the stages; out-of-range values raise ValueError."""

    chunk_words: int = 128
    chunk_overlap: float = 0.05
    repeat_ratio: float = 0.7
    header_zone: float = 0.05
    footer_zone: float = 0.95
    pdf_sample_pages: int = 3
    pdf_least_chars: int = 50
    ocr_language: str = "rus"
    ocr_dpi: int = 300
    ocr_psm: int = 4
    ocr_oem: int = 1
    ner_max_length: int = 128
    risk_max_length: int = 256
    epochs: int = 6
    batch_size: int = 16
    accumulation: int = 4
    learning_rate: float = 2e-5
    warmup_ratio: float = 0.06
    patience: int = 2
    train_ratio: float = 0.85
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        for name in ("chunk_overlap", "repeat_ratio", "header_zone", "footer_zone", "warmup_ratio", "train_ratio"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        if self.chunk_words < 2:
            raise ValueError("chunk_words must be at least 2")

    @classmethod
    def load(cls, env_file: str | None = ".env", **given: object) -> Settings:
        """Settings of the environment; ``given`` values win."""
        raw: dict[str, str] = {}
        if env_file and Path(env_file).is_file():
            for line in Path(env_file).read_text(encoding="utf-8").splitlines():
                key, sep, value = line.partition("=")
                if sep and not key.lstrip().startswith("#"):
                    raw[key.strip()] = value.strip().strip("\"'")
        raw |= os.environ
        found = {f.name: type(f.default)(raw[k]) for f in fields(cls) if (k := f"FINSTRATA_{f.name.upper()}") in raw}
        return cls(**(found | given))


def setup_logging(level: str = "INFO") -> None:
    """Plain logging of time, level, name and message."""
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)
