"""Readers: files with a declared role for each column, as batch or stream."""
