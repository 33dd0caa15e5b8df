"""Where signatures come from and where results go."""
