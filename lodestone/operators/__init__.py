"""lodestone operators."""
