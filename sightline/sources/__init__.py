"""Table schemas, readers and writers, and the adapter from the sample tables."""
