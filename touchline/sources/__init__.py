"""Reading landed files and writing tables by key."""
