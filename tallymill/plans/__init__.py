"""Plans for families of counting queries."""
