"""Registered queries, one module per operator family."""

from importlib import import_module

FAMILIES = ["joins", "history", "windows", "corpus", "text", "scalars", "evaluation", "grouped", "streams"]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"cuewright.plans.{family}")
