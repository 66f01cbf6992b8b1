"""Column functions: axis lookup, decoding, time, text and colour."""
