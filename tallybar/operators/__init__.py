"""Operators over whole series: recurrences, levels, structure, signals."""
