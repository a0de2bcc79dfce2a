"""streaming of lexmesh."""
