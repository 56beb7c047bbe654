"""Training-data operations. Nothing else in the library imports this package."""
