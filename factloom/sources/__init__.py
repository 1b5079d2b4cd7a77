"""Reading and writing the engine's files."""
