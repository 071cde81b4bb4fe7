"""Reading and writing of tables and models."""
