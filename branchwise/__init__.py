"""branchwise: git-like branches, diffs and merges for namespaces of Spark tables."""
