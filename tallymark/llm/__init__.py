"""Training-data operators at corpus scale.  Nothing else in the library imports this package."""
