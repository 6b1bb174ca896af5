"""DataFrame operators of the projection."""
