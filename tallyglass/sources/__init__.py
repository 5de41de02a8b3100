"""Where tables come from, what is known about them, and where results go."""
