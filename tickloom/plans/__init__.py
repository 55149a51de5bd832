"""Requests as JSON, validated, rewritten and compiled to DataFrame plans."""
