"""Streams of ratings."""
