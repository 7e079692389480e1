"""The request and reply protocol, in batches."""
