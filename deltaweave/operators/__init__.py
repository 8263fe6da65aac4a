"""Relational operators over records, change logs and call graphs."""
