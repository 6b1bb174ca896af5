"""Publication of the consolidated table."""
