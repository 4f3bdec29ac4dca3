"""Compositions of operators: derived views, registered queries and end-to-end jobs."""
