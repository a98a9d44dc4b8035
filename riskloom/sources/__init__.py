"""Readers and writers: repositories, scanner and secret reports, analyser replies, result tables."""
