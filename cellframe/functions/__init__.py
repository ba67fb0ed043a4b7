"""Column functions: types, complex numbers, tensors, expressions, literals."""
