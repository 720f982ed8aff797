"""Readers, writers and resumable runs."""
