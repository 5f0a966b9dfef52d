"""Reading and writing logs and layouts."""
