"""Marketplace analytics on Spark: raw files -> star schema -> marts -> KPI queries."""

from souk.params import Params

__all__ = ["Params"]
