"""DataFrame operators grouped by concern."""
