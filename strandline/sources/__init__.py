"""Readers and writers of the formats that the pipeline exchanges."""
