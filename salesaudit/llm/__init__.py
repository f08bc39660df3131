"""Operators of a training-data pipeline: scoring, formatting, scanning, packing and deduplicating texts.

Nothing else in the library imports this subpackage.
"""
