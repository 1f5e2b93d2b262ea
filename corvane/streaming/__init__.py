"""streaming of corvane."""
