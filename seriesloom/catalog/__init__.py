"""Named queries over the order tables, and reference SQL for each of them."""
