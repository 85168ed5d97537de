"""Settings with their defaults, read from the environment and a .env file."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

#: Settings that the environment cannot change (fixed values).
CONSTANT = ("frame_max_side", "thumb_size", "max_image_pixels")
TRUE = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values."""

    media_dir: str = "data/media"
    index_dir: str = "data/index"
    model_backend: str = "real"
    workers: int = 4
    video_max_frames: int = 24
    video_min_interval: float = 8.0
    video_dedupe_threshold: float = 0.97
    video_time_budget: float = 180.0
    pdf_max_text_pages: int = 300
    pdf_max_render_pages: int = 8
    pdf_max_chunks: int = 600
    frame_max_side: int = 512
    thumb_size: int = 320
    max_image_pixels: int = 120_000_000
    enable_asr: bool = False
    asr_model: str = "tiny.en"
    #: Floors and margins of a search; None: those of the embedder.
    clip_min_score: float | None = None
    text_min_score: float | None = None
    clip_margin: float | None = None
    text_margin: float | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, dotenv: str | Path | None = ".env") -> Settings:
        """Variables in upper case; what the environment has goes before the file."""
        values = {**(read_dotenv(dotenv) if dotenv else {}), **(os.environ if env is None else env)}
        found = {}
        for f in fields(cls):
            text = values.get(f.name.upper())
            if text is not None and text != "" and f.name not in CONSTANT:
                kind = float if f.default is None else type(f.default)
                found[f.name] = text.strip().lower() in TRUE if kind is bool else kind(text)
        return cls(**found)


def read_dotenv(path: str | Path) -> dict[str, str]:
    """NAME=value lines; # begins a comment line, quotes around a value go."""
    out = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, sign, value = line.strip().partition("=")
            if sign and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("\"'")
    return out
