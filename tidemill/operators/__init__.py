"""DataFrame -> DataFrame operators: filters, statistics, metrics, batching, side-cars, snapshots, segments."""
