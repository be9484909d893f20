"""Readers and writers for the file shapes that the analytics start from and end in."""
