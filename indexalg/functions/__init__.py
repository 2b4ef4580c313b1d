"""Functions of Columns and of tables of lines."""
