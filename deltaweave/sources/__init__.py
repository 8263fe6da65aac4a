"""Files as tables: records, containers, letters, messages, directories."""
