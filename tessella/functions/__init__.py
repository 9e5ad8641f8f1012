"""Functions of the engine, one module for each family."""
