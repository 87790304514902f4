"""Readers: tables, annotation files, recorded service pages, images."""
