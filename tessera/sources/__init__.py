"""Tables, schemas and backups."""
