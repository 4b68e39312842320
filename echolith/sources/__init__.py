"""Readers of encoded audio and of stored signatures."""
