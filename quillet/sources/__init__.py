"""Readers of files, XML and zoned books, and the formats an index is saved in."""
