"""Spark jobs for scheduled-trip delay data: ingest, check, train, score, analyse."""
