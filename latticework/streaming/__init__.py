"""Structured Streaming: scoring of arriving points with a fixed lattice, and training that goes on."""
