"""Conditions over repetitions and earlier events, and conversions of plain text."""
