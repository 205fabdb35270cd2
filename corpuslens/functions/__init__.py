"""Package functions of corpuslens."""
