"""Readers of files, feeds, articles and pages, and the checks and writers of results."""
