"""Readers of sample files into one table for all clients: client, split, sample, y, x."""

from vectorloom.sources.registry import SOURCES, Spec, cached, load, load_specs

__all__ = ["SOURCES", "Spec", "cached", "load", "load_specs"]
