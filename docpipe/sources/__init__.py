"""Readers with explicit schemas, and arrival-event decoding."""
