"""Text analysis, content extraction and scoring functions."""
