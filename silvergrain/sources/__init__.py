"""Archive tables, their schemas, and how they are read or derived."""
