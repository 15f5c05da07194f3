"""Where inventories come from: directory trees, existing tables, snapshots, file content."""
