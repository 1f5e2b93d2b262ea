"""plans of corvane."""
