"""Training-data operators: each module holds one operator, :mod:`.queries` binds them to the tables."""
