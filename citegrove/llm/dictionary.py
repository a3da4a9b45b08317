"""Integer dictionaries: joins with them that no frequent value can clog."""

from __future__ import annotations

from citegrove.operators.graph import join_skewed as encode

__all__ = ["encode"]
