"""Column builders: text, geometry, vectors, scores and rules, all visible to the optimizer."""
