"""Ledgerline: Spark-native analytics for ledgers, series, feeds and fares."""
