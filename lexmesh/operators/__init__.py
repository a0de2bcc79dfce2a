"""operators of lexmesh."""
