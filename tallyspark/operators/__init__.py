"""DataFrame operators: reshape, totals, quality, reconcile, stats."""
