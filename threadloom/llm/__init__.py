"""Training-data operators: one module per operator, a registry in `queries`."""
