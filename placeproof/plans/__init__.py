"""Registered queries by subject."""

from importlib import import_module

MODULES = ["scoring", "texts", "places", "resolution", "logs", "payloads", "copies", "streams", "phrases"]


def load() -> None:
    for name in MODULES:
        import_module(f"placeproof.plans.{name}")
