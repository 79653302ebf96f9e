"""Column functions: truth logic, lists, strings, locations, and ways to combine them."""
