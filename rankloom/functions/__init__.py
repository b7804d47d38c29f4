"""Column functions: text normalisation, parsing, overlap and vector arithmetic."""
