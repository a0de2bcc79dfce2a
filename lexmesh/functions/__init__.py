"""functions of lexmesh."""
