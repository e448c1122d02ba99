"""Reading and writing of the engine's tables and of its text formats."""
