"""End-to-end exports and the queries registered for checking."""
