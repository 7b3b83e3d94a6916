"""Tape analytics on Spark: trade calls in chat messages, replayed on daily bars."""
