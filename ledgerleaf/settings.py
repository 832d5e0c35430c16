"""Settings and where they come from: the session's configuration, then the environment, then defaults.

``ledgerleaf.<name>`` in the session wins over ``<NAME>`` in the environment.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import SparkSession

_YES, _NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


@dataclass(frozen=True)
class Settings:
    default_engine: str = "traditional"
    # Keys are kept out of the printed form.
    gemini_api_key: str = field(default="", repr=False)
    openai_api_key: str = field(default="", repr=False)
    deepseek_api_key: str = field(default="", repr=False)
    llm_api_key: str = field(default="", repr=False)
    llm_provider: str = "gemini"
    llm_model: str = ""
    vision_model: str = ""
    llm_max_tokens: int = 8192
    llm_timeout_seconds: float = 120.0
    llm_max_retries: int = 3
    ocr_backend: str = "paddle"
    ocr_languages: str = "ar,en"
    ocr_min_confidence: float = 0.50
    tesseract_cmd: str = ""
    pdf_dpi: int = 300
    max_image_px: int = 2500
    deskew: bool = True
    auto_crop: bool = True
    fix_lighting: bool = True
    amount_tolerance: float = 0.02
    review_confidence_threshold: float = 0.80
    store_path: str = ""
    log_level: str = "info"
    max_upload_mb: int = 25

    def __post_init__(self):
        for name in ("default_engine", "ocr_backend", "log_level"):
            object.__setattr__(self, name, getattr(self, name).strip().lower())

    @property
    def languages(self) -> list[str]:
        return [x for x in (part.strip().lower() for part in self.ocr_languages.split(",")) if x]

    @property
    def persistence_enabled(self) -> bool:
        return bool(self.store_path.strip())

    @property
    def models_enabled(self) -> bool:
        return any(getattr(self, f.name).strip() for f in fields(self) if f.name.endswith("_api_key"))

    def api_key(self, provider: str) -> str:
        """The provider's own key, or the one that all share."""
        return getattr(self, f"{provider.strip().lower()}_api_key", "").strip() or self.llm_api_key.strip()


def _typed(name: str, kind: type, text: str) -> Any:
    if kind is bool:
        word = text.strip().lower()
        if word not in _YES + _NO:
            raise ValueError(f"{name} is a yes or no, not {text!r}")
        return word in _YES
    try:
        return kind(text.strip() if kind is not str else text)
    except ValueError as why:
        raise ValueError(f"{name} takes {kind.__name__}, not {text!r}") from why


def load(spark: SparkSession | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Settings of this session.  Names that none of the settings has are ignored."""
    around = {k.lower(): v for k, v in (os.environ if environment is None else environment).items()}
    given: dict[str, Any] = {}
    for f in fields(Settings):
        value = spark.conf.get(f"ledgerleaf.{f.name}", None) if spark else None
        value = around.get(f.name) if value is None else value
        if value is not None:
            given[f.name] = _typed(f.name, type(f.default), value)
    return Settings(**given)
