"""Query plans of the engine, by subject."""

from importlib import import_module

SUBJECTS = ("gym", "waitlist", "members", "sequences", "world", "cameras", "views", "recordings", "reps", "streams")


def registries() -> list:
    return [import_module(f"{__name__}.{s}").query for s in SUBJECTS]
