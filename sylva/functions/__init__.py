"""Column functions: paths, names of conflict copies, content hashes."""
