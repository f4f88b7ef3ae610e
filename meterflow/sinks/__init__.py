"""Table layouts, upsert views and exports."""
