"""Table readers and adapter views."""
