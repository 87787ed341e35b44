"""Queries, by module; importing this package registers them."""

from . import ingest, lecture, media, models, rewriting, sinks  # noqa: F401
