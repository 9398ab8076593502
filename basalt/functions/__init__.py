"""Column functions: codecs, formats, chunk arithmetic."""
