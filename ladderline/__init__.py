"""Match ratings as Spark jobs: sources, merge, rating fold, rankings and agreement statistics."""
