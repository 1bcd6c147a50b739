"""The operators, by family; importing a module registers what it holds in the catalog."""
