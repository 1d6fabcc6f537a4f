"""Profile, drill, estimate, choose and fold."""
