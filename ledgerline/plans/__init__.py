"""Ledgerline plans."""
