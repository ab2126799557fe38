"""The operators run over the driver tables, with an SQL twin for each query."""

from importlib import import_module

AREAS = [
    "flow_queries",
    "source_queries",
    "signature_queries",
    "packet_queries",
    "upload_queries",
    "metric_queries",
    "stream_queries",
    "model_queries",
]


def load():
    """Import every query area and return the registry."""
    for area in AREAS:
        import_module(f"workload.{area}")
    return import_module("workload.registry")
