"""Settings of the engine, from the environment; unknown keys are ignored."""

from __future__ import annotations

import logging
import os
import sys
from collections.abc import Mapping
from dataclasses import dataclass, fields

_PREFIX = "LOOMWRIGHT_"


@dataclass(frozen=True)
class Settings:
    app_name: str = "loomwright"
    app_version: str = "0.1.0"
    log_level: str = "INFO"
    chunk_size: int = 1200
    chunk_overlap: int = 200
    max_upload_bytes: int = 1_048_576

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, env_file: str | None = None) -> Settings:
        """Values from ``LOOMWRIGHT_*`` variables, over those of a ``KEY=value`` file if one is named, over the defaults."""
        found: dict[str, str] = {}
        if env_file and os.path.exists(env_file):
            with open(env_file, encoding="utf-8") as lines:
                pairs = (x.strip().partition("=") for x in lines if "=" in x and not x.lstrip().startswith("#"))
                found = {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}
        found |= os.environ if env is None else env
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kind(found[_PREFIX + k.upper()]) for k, kind in kinds.items() if _PREFIX + k.upper() in found})


def configure_logging(settings: Settings | None = None) -> logging.Logger:
    """Driver-side log lines on stdout, in one format."""
    settings = settings or Settings.load()
    logger = logging.getLogger("loomwright")
    if not logger.handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
    logger.setLevel(settings.log_level.upper())
    return logger
