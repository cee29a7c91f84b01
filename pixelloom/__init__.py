"""pixelloom: a Spark engine that treats image files as rows of a binary table."""
