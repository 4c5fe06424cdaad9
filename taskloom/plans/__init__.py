"""Queries of the engine's own operators; importing any of these modules registers all."""

from . import catalogue, graphs, reading, restarting, scheduling  # noqa: F401
