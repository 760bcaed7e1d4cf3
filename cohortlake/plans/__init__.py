"""Layer builds and the catalogue of registered queries."""
