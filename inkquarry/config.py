"""Settings: from the session (spark.inkquarry.<name>), else the environment (INKQUARRY_<NAME>), else the defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Fixed values of the document engine, all of which a session or the environment may change."""

    model_url: str = "http://localhost:11434"
    model_name: str = "gemma4:4b"
    model_timeout: int = 120
    model_attempts: int = 3
    model_calls: int = 4  #: questions that a task has under way at once
    answers_folder: str = ""  #: where answers of models last; '': nowhere
    confidence_threshold: float = 0.7
    most_figures: int = 0  #: figures kept of a paper; 0: all
    image_dpi: int = 300
    least_figure_area: int = 10_000
    rmse_threshold: float = 0.05
    log_level: str = "INFO"

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        found = {}
        for f in fields(cls):
            raw = spark.conf.get(f"spark.inkquarry.{f.name}", None) or os.environ.get(f"INKQUARRY_{f.name.upper()}")
            if raw is not None:
                found[f.name] = type(f.default)(raw)
        return cls(**found)
