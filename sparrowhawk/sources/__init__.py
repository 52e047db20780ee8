"""Sparrowhawk sources."""
