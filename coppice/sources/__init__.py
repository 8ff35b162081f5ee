"""Tables in, tables and models out."""
