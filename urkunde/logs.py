"""The driver's log: to the console and, if asked for, to a file."""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass


@dataclass(frozen=True)
class LoggingConfig:
    # Defaults.
    level: str = "INFO"
    format: str = "%(asctime)s - %(name)s - %(levelname)s - %(message)s"
    file_path: str | None = None


def setup(config: LoggingConfig, name: str = "urkunde") -> logging.Logger:
    """The logger with these settings alone; earlier handlers go."""
    logger = logging.getLogger(name)
    targets = [logging.StreamHandler(sys.stdout)] + ([logging.FileHandler(config.file_path)] if config.file_path else [])
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    for target in targets:
        target.setFormatter(logging.Formatter(config.format))
        logger.addHandler(target)
    logger.setLevel(config.level.upper())
    return logger
