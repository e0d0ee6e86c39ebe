"""Column functions: probabilities, vectors, quantisation, hashes."""
