"""Varaka: Spark jobs for document-heavy public-service work and training data."""
