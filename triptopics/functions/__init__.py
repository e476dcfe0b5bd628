"""triptopics."""
