"""Readers and writers: flow files, signature alert text, packets, topics, reports."""
