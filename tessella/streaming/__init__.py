"""Structured streams of the store's log."""
