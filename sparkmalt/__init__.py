"""A PySpark engine for price lists, product catalogues and order analytics."""
