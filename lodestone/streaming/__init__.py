"""Structured Streaming forms of the ingest: files are taken as they arrive, and a stopped run resumes at its checkpoint."""
