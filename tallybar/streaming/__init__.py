"""Bars and recursive averages over streams."""
