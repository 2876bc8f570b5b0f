"""DataFrame jobs for large document collections."""
