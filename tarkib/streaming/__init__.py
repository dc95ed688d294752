"""Structured Streaming: builds that are taken up again, tables that follow a log."""
