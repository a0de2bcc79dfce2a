"""plans of lexmesh."""
