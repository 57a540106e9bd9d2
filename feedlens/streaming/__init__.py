"""Structured Streaming operators T1–T3 (batch twins live in ``feedlens.operators``)."""
