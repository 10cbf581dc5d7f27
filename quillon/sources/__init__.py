"""Readers and writers of the formats and services that data comes from and goes to."""
