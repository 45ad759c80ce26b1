"""Scalar expressions over cells, bands, text and colours; all stay inside code generation."""
