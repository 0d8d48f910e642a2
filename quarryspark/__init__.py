"""Document-knowledge, retrieval and usage analytics as plain DataFrame -> DataFrame functions."""
