"""Readers and writers of the formats that fragment tools exchange."""
