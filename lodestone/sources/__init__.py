"""Readers and writers of text, JSON lines, hash lists and binary token files, over any file system that Spark or Arrow knows."""
