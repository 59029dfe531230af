"""Column functions: all built-in expressions, save the byte codecs."""
