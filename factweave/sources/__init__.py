"""Readers, writers and the providers that stand in for network, PDF and model calls."""
