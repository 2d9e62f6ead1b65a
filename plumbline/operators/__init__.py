"""What can be asked of a dataset, and of the tables that describe datasets."""
