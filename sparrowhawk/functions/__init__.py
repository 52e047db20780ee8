"""Sparrowhawk functions."""
