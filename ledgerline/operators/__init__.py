"""Ledgerline operators."""
