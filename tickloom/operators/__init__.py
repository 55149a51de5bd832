"""Dataflow operators over streams of (symbol, ts, seq, pos, value)."""
