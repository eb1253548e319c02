"""Scans of raw filings, prices and JSON, and sinks for features and records."""
