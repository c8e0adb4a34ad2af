"""Sources of units: source trees, git, and tables."""
