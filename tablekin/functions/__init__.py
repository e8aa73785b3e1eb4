"""Column functions: value classes, match keys, ids and bit words."""
