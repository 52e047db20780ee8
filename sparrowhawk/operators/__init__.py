"""Sparrowhawk operators."""
