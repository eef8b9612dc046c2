"""Views and composed queries."""
