"""Reading pages and writing results."""
