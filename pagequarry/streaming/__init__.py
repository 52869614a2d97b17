"""The same conversions over streams of pages."""
