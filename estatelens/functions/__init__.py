"""Column functions, fixed vocabularies and helpers that keep jobs balanced at scale."""
