"""Graphs that grow: triples appended by a stream."""
