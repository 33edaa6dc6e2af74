"""Operators on texts: encoding, packing, sentence boundaries. Nothing outside this package imports it."""
