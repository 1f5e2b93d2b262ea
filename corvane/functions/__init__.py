"""functions of corvane."""
