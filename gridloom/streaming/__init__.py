"""Extension: frames of event streams as images."""
