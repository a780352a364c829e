"""Where indexes are stored."""
