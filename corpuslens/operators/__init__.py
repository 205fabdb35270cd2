"""Package operators of corpuslens."""
