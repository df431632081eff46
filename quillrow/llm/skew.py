"""Joins of rows to what is known about their key, whatever share of the rows one key has."""

from __future__ import annotations

from ..plans.skew import PARTS, spread_join

__all__ = ["PARTS", "spread_join"]
