"""Column functions and small numeric routines."""
