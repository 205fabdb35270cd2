"""Package plans of corpuslens."""
