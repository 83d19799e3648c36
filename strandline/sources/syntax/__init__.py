"""Declarations and calls of source files, from tokens and matched brackets."""
