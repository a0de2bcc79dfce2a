"""sources of lexmesh."""
