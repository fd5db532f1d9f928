"""Basalt: knowledge and asset analytics expressed as PySpark plans."""
