"""Bindings, analyses, similarity and checks over graphs."""
