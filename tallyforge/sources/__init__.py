"""Readers, writers and the ledger tables."""
