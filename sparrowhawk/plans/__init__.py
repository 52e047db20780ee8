"""Sparrowhawk plans."""
