"""Logging of this package only; the root logger is left alone."""

from __future__ import annotations

import json
import logging


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        found = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        return json.dumps(found | getattr(record, "context", {}), default=str)


def setup_logging(level: str = "INFO", format_type: str = "text", include_timestamp: bool = True) -> logging.Logger:
    logger = logging.getLogger("quillrow")
    handler = logging.StreamHandler()
    plain = ("%(asctime)s " if include_timestamp else "") + "%(levelname)s %(name)s: %(message)s"
    handler.setFormatter(JsonFormatter() if format_type == "json" else logging.Formatter(plain))
    logger.handlers[:] = [handler]
    logger.setLevel(level)
    return logger


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(f"quillrow.{name}")


def log_with_context(logger: logging.Logger, level: str, message: str, **context) -> None:
    logger.log(logging.getLevelName(level), message, extra={"context": context})
