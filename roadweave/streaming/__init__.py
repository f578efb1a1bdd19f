"""Structured Streaming forms: watermarks, windows, joins and keyed state."""
