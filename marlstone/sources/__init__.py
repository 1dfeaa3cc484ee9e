"""sources of the catalogue engine."""
