"""Column functions: geometry and space-filling curves."""
