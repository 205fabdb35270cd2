"""Package streaming of corpuslens."""
