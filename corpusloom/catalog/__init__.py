"""Named queries over the provided tables and their independent SQL."""
