"""Parsers that turn source text into rows of a syntax tree."""
