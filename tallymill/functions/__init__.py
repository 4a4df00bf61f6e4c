"""Column encoders, codecs and census functions."""
