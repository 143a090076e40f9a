"""Column functions: parsing of descriptions and codes, text, vectors, dates."""
