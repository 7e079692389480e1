"""Relations and where they come from."""
