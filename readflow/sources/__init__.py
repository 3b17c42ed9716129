"""Readers and writers: files, e-books, JSON stores."""
