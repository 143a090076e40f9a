"""Readers of text logs, instrument files, Markdown, registries, and a date-chunked data source."""
