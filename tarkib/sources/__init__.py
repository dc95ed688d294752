"""Readers of lexicons, corpora and pages, and writers of lexicons, data sets and reports."""
