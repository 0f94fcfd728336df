"""Readers: driver tables, chat datasets, tool catalogues, label files, runs."""
