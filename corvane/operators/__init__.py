"""operators of corvane."""
