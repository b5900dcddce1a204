"""lodestone streaming."""
