"""Reading and writing of tables and text formats."""
