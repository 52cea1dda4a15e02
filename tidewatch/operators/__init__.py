"""DataFrame-to-DataFrame operators: each is lazy and treats all batches in one plan."""
