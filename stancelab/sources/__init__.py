"""Readers and writers: Parquet tables, CSV banks, JSON summaries, embedding slices."""
