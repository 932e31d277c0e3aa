"""Derived inputs and the registered queries with their SQL twins."""

from importlib import import_module

MODULES = ["labels_q", "profile_q", "metrics_q", "splits_q", "windows_q", "ensemble_q", "uncertainty_q", "runs_q", "sources_q", "streaming_q", "images_q"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"assay.plans.{name}")
