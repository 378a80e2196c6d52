"""Ledgerline streaming."""
