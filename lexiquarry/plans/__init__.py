"""From a query string to what has to be computed."""
