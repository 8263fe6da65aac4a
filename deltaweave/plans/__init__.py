"""The library's operators over the star-schema tables, as named queries."""
