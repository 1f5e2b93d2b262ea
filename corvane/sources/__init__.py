"""sources of corvane."""
