"""Training-data operators: each is one module; nothing else in the library imports this package."""
