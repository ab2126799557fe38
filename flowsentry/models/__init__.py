"""Anomaly models fitted and applied on executors."""
