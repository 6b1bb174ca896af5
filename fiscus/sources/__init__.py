"""Fact, parameter and manual-row sources."""
