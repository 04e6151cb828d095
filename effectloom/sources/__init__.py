"""Readers, sinks, multi-table assembly and the catalogue."""
