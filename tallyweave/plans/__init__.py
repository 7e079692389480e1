"""Query text, its intermediate form, and the way from there to a DataFrame."""
