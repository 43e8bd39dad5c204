"""Readers and writers of files and documents."""
