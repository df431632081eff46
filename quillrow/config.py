"""Run settings."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from .errors import ConfigurationError


@dataclass(frozen=True)
class EnrichmentConfig:
    """Settings of one run.

    ``max_workers`` bounds the calls in flight over the whole cluster: tasks
    get a lease from the driver for each, however the rows are partitioned.  ``checkpoint_interval`` rows of
    a level, 0 for all, are stored at a time when checkpoints are on.  A run
    logs at ``log_level`` and draws its progress on a terminal if
    ``enable_progress_bar`` says so.  Checkpoints need an explicit
    ``checkpoint_dir`` in a folder that all executors share; the cache has a
    folder of its own below the shared one unless ``cache_dir`` names another.
    """

    max_tokens: int = 4000
    temperature: float = 0.2
    max_workers: int = 10
    overwrite_fields: bool = False
    max_retries: int = 3
    retry_base_delay: float = 1.0
    on_error: str = "continue"
    log_level: str = "INFO"
    enable_progress_bar: bool = True
    enable_checkpointing: bool = False
    checkpoint_dir: str | None = None
    auto_resume: bool = True
    enable_caching: bool = False
    cache_ttl: int = 3600
    cache_dir: str | None = None
    checkpoint_interval: int = 0
    dedupe: bool = False

    def __post_init__(self):
        wrong = [
            ("temperature must lie between 0 and 2", not 0 <= self.temperature <= 2),
            ("max_tokens must be positive", self.max_tokens <= 0),
            ("max_workers must be positive", self.max_workers <= 0),
            ("max_retries must not be negative", self.max_retries < 0),
            ("retry_base_delay must not be negative", self.retry_base_delay < 0),
            ("cache_ttl must not be negative", self.cache_ttl < 0),
            ("checkpoint_interval must not be negative", self.checkpoint_interval < 0),
            ("on_error must be 'continue' or 'raise'", self.on_error not in ("continue", "raise")),
            ("log_level must name a level", self.log_level not in logging.getLevelNamesMapping()),
            ("checkpointing needs checkpoint_dir", self.enable_checkpointing and not self.checkpoint_dir),
        ]
        for message, holds in wrong:
            if holds:
                raise ConfigurationError(message)

    def but(self, **changes) -> EnrichmentConfig:
        return replace(self, **changes)

    @classmethod
    def for_development(cls, **changes) -> EnrichmentConfig:
        return cls(**{"max_workers": 5, "log_level": "DEBUG", "enable_caching": True, **changes})

    @classmethod
    def for_production(cls, checkpoint_dir: str, **changes) -> EnrichmentConfig:
        own = {"max_workers": 30, "enable_checkpointing": True, "enable_caching": True, "checkpoint_interval": 100, "max_retries": 5}
        return cls(**{**own, "checkpoint_dir": checkpoint_dir, **changes})

    @classmethod
    def for_server(cls, **changes) -> EnrichmentConfig:
        return cls(**{"max_workers": 30, "enable_progress_bar": False, "max_retries": 5, "log_level": "WARNING", **changes})
