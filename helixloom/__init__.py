"""Variant analytics as DataFrame operators."""
