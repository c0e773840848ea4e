"""Readers of note vaults."""
