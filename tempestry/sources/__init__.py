"""Readers, request planning and writers."""
