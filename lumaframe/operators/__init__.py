"""DataFrame operators, and NumPy kernels where built-in expressions can't state the semantics."""
