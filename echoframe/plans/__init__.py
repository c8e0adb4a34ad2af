"""Plans that put operators together, and the tables between them."""
