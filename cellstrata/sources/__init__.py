"""Readers and writers of the tables the operators work on."""
