"""DataFrame operators: parsing, extraction, tables, rendering and structure."""
