"""The category catalogue and the end-to-end plan."""
