"""From a query text to a DataFrame."""
