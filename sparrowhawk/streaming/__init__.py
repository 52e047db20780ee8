"""Sparrowhawk streaming."""
