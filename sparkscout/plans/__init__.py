"""End-to-end plans: discovery, ranking and the diversity-capped top list."""

from .discovery import diverse_top, discover, rank

__all__ = ["discover", "rank", "diverse_top"]
