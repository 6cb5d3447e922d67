"""Registered queries: importing this package fills the registry."""

from . import bootstraps, flat, inventory, ledgers, more, reports, scores, spatial

__all__ = ["bootstraps", "flat", "inventory", "ledgers", "more", "reports", "scores", "spatial"]
