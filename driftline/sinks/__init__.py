"""Sinks: plans applied to stores, uploads in parts, saved uploads, logs."""
