"""Column functions: text, hashes, arrays and maths, all built-in expressions but where a docstring says Arrow."""
