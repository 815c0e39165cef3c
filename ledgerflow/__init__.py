"""Event feeds to deduplicated tables, as composable PySpark operators."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
