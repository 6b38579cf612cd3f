"""Daily cells: readers, derivations from event tables, data-quality rules."""
