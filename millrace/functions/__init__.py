"""Column functions; each is a built-in expression that Catalyst can see through."""
