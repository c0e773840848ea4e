"""Operators over notes, tasks, tags, headings, chunks and vectors."""
