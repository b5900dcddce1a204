"""lodestone sources."""
