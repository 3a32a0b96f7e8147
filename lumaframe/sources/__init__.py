"""Readers and writers: image folders, datasets, frames."""
