"""Column-level functions: protection rules, normal forms, language codes."""
