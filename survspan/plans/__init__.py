"""Skew-safe building blocks shared by the operators."""

from .scan import BLOCK, blocks_for_hot_groups, blocks_from_quantiles, blocks_from_rank, ordered_scan

__all__ = ["BLOCK", "ordered_scan", "blocks_from_rank", "blocks_from_quantiles", "blocks_for_hot_groups"]
