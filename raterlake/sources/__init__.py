"""Reading and writing ratings, predictions, factors and metric tables."""
