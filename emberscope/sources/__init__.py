"""Where profiles come from and results go to."""
