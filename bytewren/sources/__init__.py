"""Readers and writers: byte streams, tensor files, vocabularies, containers, telemetry."""
