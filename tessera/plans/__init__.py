"""Plans shown and measured; the catalogue of registered queries."""
